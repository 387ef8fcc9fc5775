"""Small catalogues for tests."""

WIDGETS = """
▸ overview [not-read]
  AA-001  Обзор | Overview  [side:false|position:false]
### ДЕТАЛИЗАЦИЯ ###
######  TestCat 🆕  ######
▸ Group A / Группа [grp-a] (1)
  XX-001  Альфа | Alfa (widget)  [side:false|position:false]
  синонимы: alfa
▸ Group B [grp-b]
  XX-002  Бета | Beta  [side:false|position:false]
  XX-003  Гамма | Gamma  [side:false|position:false]
  синонимы: widget, beta syn,
"""

MIRRORS = """ДЕТАЛИЗАЦИЯ
▸ Loose [no-cat]
  LO-001  Без категории | Kateqoriyasız  [side:false|position:false]
######## Кузов и оптика ########
  ZZ-999  Сирота | Orphan  [side:true|position:true]
  синонимы: orphan word
▸ Güzgülər / Kənar / Зеркала / боковые [kz-mirror]
  KZ-020  Зеркало | Yan güzgü  [side:true|position:false]
  KZ-022  Корпус/крышка зеркала | Güzgü korpusu/qapağı  [side:true|position:false]
  синонимы: güzgü, emblema
▸ Faralar [kz-lamp]
  KZ-005  Фара | Fara (ön işıq)  [side:true|position:true]
  синонимы: fara dəsti, kabel fara
######## Подвеска ########
▸ Stupisa (toplar) / podşipniklər / Ступицы/подшипники [as-hub]
  AS-007  Подшипник ступицы | Stupitsa podşipniki  [side:true|position:true]
▸ Traves [as-traves]
  AS-016  Подрамник | Traves (podramnik)  [side:false|position:false]
  AS-017  Траверса | Traves arxa  [side:false|position:false]
  синонимы: traves, emblema (logo, loqo)
▸ Again [kz-lamp]
  KZ-006  Лампа | Fara lampası  [side:false|position:false]
  AS-016  Подрамник новый | Traves yeni  [side:true|position:false]
nothing known here
"""
