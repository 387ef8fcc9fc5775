"""What `python -m matchloom` does: match one phrase, resolve one word, audit a catalogue, and write or check its derived files."""

from __future__ import annotations

import argparse
import json
import os

from pyspark.sql import SparkSession

#: The catalogue that is read unless --dict names another.
CATALOGUE = "data/catalogue.txt"


def _match(spark: SparkSession, args: argparse.Namespace) -> int:
    from .operators.matching import match_one
    from .sources.catalogue import parse_file

    catalogue = parse_file(spark, args.path).persist()
    print(json.dumps(match_one(catalogue, args.phrase, args.raw, args.threshold, args.category), ensure_ascii=False, indent=2))
    catalogue.unpersist()
    return 0


def _category(spark: SparkSession, args: argparse.Namespace) -> int:
    from .session import CategoryMatcher
    from .sources.catalogue import parse_file

    found = CategoryMatcher.from_file(spark, args.index) if args.index else CategoryMatcher.from_catalogue(parse_file(spark, args.path))
    print(json.dumps(found.resolve(args.word, args.raw, args.threshold), ensure_ascii=False, indent=2))
    found.close()
    return 0


def _audit(spark: SparkSession, args: argparse.Namespace) -> int:
    from .operators.quality import collisions
    from .sources.catalogue import parse_file

    rows = collisions(parse_file(spark, args.path)).collect()
    for row in rows:
        print(f"{row['key']}: a name of {', '.join(row['part_ids'])}, and a synonym of {', '.join(row['other_leaves'])}")
    print(f"{len(rows)} names are synonyms of other leaves")
    return int(bool(rows))


def _derived(spark: SparkSession, args: argparse.Namespace) -> int:
    from .operators.categories import category_index
    from .plans.reports import index_text, report_text
    from .sources.catalogue import parse_file

    catalogue = parse_file(spark, args.path)
    text = report_text(catalogue) if args.command == "names" else index_text(category_index(catalogue))
    fresh = text.encode()
    if args.check:
        held = b""
        if os.path.exists(args.out):
            with open(args.out, "rb") as f:
                held = f.read()
        print(f"{args.out} is {'up to date' if held == fresh else 'stale'}")
        return int(held != fresh)
    with open(args.out, "wb") as f:
        f.write(fresh)
    print(f"{args.out}: {len(fresh)} bytes")
    return 0


def _parser() -> argparse.ArgumentParser:
    common = argparse.ArgumentParser(add_help=False)
    common.add_argument("--dict", default=CATALOGUE, dest="path", help="the catalogue file")
    top = argparse.ArgumentParser(prog="matchloom", description="Match phrases against a catalogue, audit it, and keep its derived files fresh.")
    commands = top.add_subparsers(dest="command", required=True)
    match = commands.add_parser("match", parents=[common], help="one phrase's result as JSON (the default command)")
    match.add_argument("phrase")
    match.add_argument("--raw", help="raw text in which side and position are looked for")
    match.add_argument("--threshold", type=float, default=0.90, help="least similarity of a near match; 1.0 is exact only")
    match.add_argument("--category", help="keep candidates of this category only")
    match.set_defaults(run=_match)
    category = commands.add_parser("category", parents=[common], help="one word's category as JSON")
    category.add_argument("word")
    category.add_argument("--raw", help="raw text that is passed on")
    category.add_argument("--threshold", type=float, default=0.90, help="least similarity of a near word; 1.0 is exact only")
    category.add_argument("--index", help="a category index as JSON, instead of the catalogue")
    category.set_defaults(run=_category)
    commands.add_parser("audit", parents=[common], help="fail if a name is a synonym of another leaf").set_defaults(run=_audit)
    for name, out in (("names", "data/canonical_names.md"), ("index", "data/category_index.json")):
        derived = commands.add_parser(name, parents=[common], help=f"write {out}")
        derived.add_argument("--out", default=out)
        derived.add_argument("--check", action="store_true", help="write nothing; fail unless the file is what would be written, byte for byte")
        derived.set_defaults(run=_derived)
    return top


def main(argv: list[str]) -> int:
    """The exit code of a command line. A line that begins with no command is a phrase to match."""
    if argv and argv[0] not in ("match", "category", "audit", "names", "index", "-h", "--help"):
        argv = ["match", *argv]
    args = _parser().parse_args(argv)
    return args.run(SparkSession.builder.getOrCreate(), args)
