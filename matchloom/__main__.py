"""python -m matchloom PHRASE | category | audit | names | index: see commands."""

import sys

from .commands import main

sys.exit(main(sys.argv[1:]))
