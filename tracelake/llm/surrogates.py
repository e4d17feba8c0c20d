"""Surrogates for personal data, with DataFrame functions only.

Texts are split at detected entities. Distinct entities (in a normal form, so that one person's
address is one entity however it is written) get surrogates drawn from a keyed digest: digits for
digits, letters for letters of the same script and case, names for names of the same gender,
valid check digits for valid ones. Surrogates are accepted in rounds: one that equals another
entity's surrogate or any real entity is drawn again, so different entities stay different. The
accepted table is joined back to the pieces and texts are put together in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.llm.common import stored

_END = r"(?![\p{L}\p{N}])"
_START = r"(?<![\p{L}\p{N}])"
#: What is detected, in order of precedence. Possessive runs behind a left edge keep matching linear.
KINDS = {
    "secret": r"(?i:(?<![\p{L}\p{N}])(?:password|passwd|pwd|token|secret|api[_-]?key|access[_-]?key)\s{0,8}[=:]\s{0,8}[\"']?"
              r"(?=[^\s\"']{0,64}\d)[A-Za-z0-9+/_\-.]{5,}+[A-Za-z0-9+/_\-]?)",
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]{1,63}(?:\.[\p{L}\p{N}-]{1,63}){0,8}\.\p{L}{2,24}" + _END,
    "ip": r"(?<![\p{N}.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?![\p{L}\p{N}]|\.\p{N})",
    "iban": _START + r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?" + _END,
    "card": _START + r"(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3}|\d{4}[ -]\d{6}[ -]\d{5})" + _END,
    "ssn": _START + r"\d{3}-\d{2}-\d{4}" + _END,
    "phone": r"(?<![\p{L}\p{N}+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{3,4}[ .-]\d{3,4}" + _END,
    "name": _START + r"(?:Mr|Mrs|Ms|Miss|Mme|Mlle|Monsieur|Madame|Herr|Frau|Señora|Señor|Господин|Госпожа)\.? \p{Lu}\p{Ll}++(?: \p{Lu}\p{Ll}++)?",
}
PATTERN = "|".join(KINDS.values())
#: Every match holds one of these.
HINT = r"[\p{N}@]|M(?:r|s|iss|me|lle|onsieur|adame)|Herr|Frau|Señor|Господин|Госпожа"
SECRET_HEAD = r"^(?i:[a-z_-]+\s*[=:]\s*[\"']?)"
TITLE = r"^\p{L}+\.? "
FEMALE = r"^(?:Mrs|Ms|Miss|Mme|Mlle|Madame|Frau|Señora|Госпожа)\b"

#: Surrogate names by gender and script.
GIVEN = {
    ("f", "latin"): "Ada Bea Cora Dina Edda Flora Greta Hanna Ines Julia Karla Lena Mina Nora Olga Paula".split(),
    ("m", "latin"): "Adam Ben Carl David Emil Felix Georg Hugo Ivan Jonas Kurt Leon Max Nils Otto Paul".split(),
    ("f", "cyrillic"): "Анна Вера Дарья Елена Зоя Ирина Лидия Мария Нина Ольга Раиса Софья Тамара Ульяна Юлия Яна".split(),
    ("m", "cyrillic"): "Антон Борис Виктор Глеб Денис Егор Игорь Кирилл Лев Марк Никита Олег Павел Роман Семён Тимур".split(),
}
FAMILY = {
    "latin": "Abel Berg Cole Dahl Eder Falk Gray Holm Iver Jung Kern Lund Moor Nord Orth Peel Quast Rohde Stone Thorn Ulm Vogt Wald Zorn".split(),
    "cyrillic": "Белых Волк Гончар Дорош Ермак Жук Заяц Кравец Лось Мороз Нагай Орлик Пастух Ромашка Седых Ткач Усач Фомич Хмель Черных Шевчук Щербак Юрко Яблок".split(),
}
LETTERS = "abcdefghijklmnopqrstuvwxyz"
#: Lower-case letters of each script, to draw from.
SCRIPTS = {
    r"[a-z]": LETTERS, r"[ß-ÿ]": "àáâäçèéêëíîïñóôöùúûü", r"[а-яё]": "абвгдежзиклмнопрстуфхцчшщэюя",
    r"[α-ωά-ώ]": "αβγδεζηθικλμνξοπρστυφχψω", r"[ぁ-ゖ]": "あいうえおかきくけこさしすせそたちつてとなにぬねの", r"[一-鿿]": "安白城大東風高海江金林明南平清山水田文西小新雨中",
}


def kind_of(match: Column) -> Column:
    out = F
    for kind, pattern in KINDS.items():
        out = out.when(match.rlike(f"^(?:{pattern})$"), F.lit(kind))
    return out.otherwise(F.lit("phone"))


def value_of(kind: Column, match: Column) -> Column:
    """The part of a match that is replaced: secrets keep their label, names their title."""
    return (F.when(kind == "secret", F.regexp_replace(match, SECRET_HEAD, ""))
            .when(kind == "name", F.regexp_replace(match, TITLE, "")).otherwise(match))


def normal_of(kind: Column, value: Column) -> Column:
    """One form for all spellings of an entity."""
    return (F.when(kind == "secret", value).when(kind.isin("card", "ssn", "iban"), F.upper(F.regexp_replace(value, r"[^\p{L}\p{N}]", "")))
            .when(kind == "phone", F.concat(F.when(value.startswith("+"), "+").otherwise(""), F.regexp_replace(value, r"\D", "")))
            .otherwise(F.lower(value)))


def digest(key: str, *parts: Column) -> Column:
    """128 keyed bytes as hexadecimal digits."""
    return F.concat(*(F.sha2(F.concat_ws("\x1f", F.lit(key), F.lit(str(i)), *parts), 256) for i in range(4)))


def number(hexed: Column, at: Column | int) -> Column:
    """Byte ``at`` of a digest."""
    at = F.lit(at) if isinstance(at, int) else at
    return F.conv(F.substring(hexed, at.cast("int") % 128 * 2 + 1, F.lit(2)), 16, 10).cast("int")


def pick(letters: str | list[str], n: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, letters)), (n % len(letters) + 1).cast("int"))


def drawn(char: Column, n: Column, hexadecimal: Column) -> Column:
    """A character of the same class, script and case as ``char``; signs stay."""
    low = F.lower(char)
    out = F.when(hexadecimal & char.rlike("[0-9a-f]"), pick("0123456789abcdef", n)).when(char.rlike(r"\p{N}"), (n % 10).cast("string"))
    for script, letters in SCRIPTS.items():
        out = out.when(low.rlike(script), pick(letters, n))
    out = out.when(char.rlike(r"\p{L}"), pick(LETTERS, n)).otherwise(char)
    return F.when(char != low, F.upper(out)).otherwise(out)


def redraw(text: Column, hexed: Column, hexadecimal: Column = None) -> Column:
    """Every letter and digit of ``text`` drawn anew."""
    hexadecimal = F.lit(False) if hexadecimal is None else hexadecimal
    return F.array_join(F.transform(F.split(text, ""), lambda c, i: drawn(c, number(hexed, i), hexadecimal)), "")


def check_digit(body: Column) -> Column:
    """The Luhn digit that completes ``body``."""
    digits = F.transform(F.split(F.reverse(body), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int") * 2).otherwise(c.cast("int")))
    total = F.aggregate(digits, F.lit(0), lambda a, d: a + F.when(d > 9, d - 9).otherwise(d))
    return ((10 - total % 10) % 10).cast("string")


def octet(part: Column, n: Column, free: Column) -> Column:
    size = F.when(free, F.lit(9)).otherwise(F.length(part))
    return F.when(size == 1, n % 10).when(size == 2, 10 + n % 90).when(size == 3, 100 + n % 156).otherwise(n).cast("string")


def surrogate(key: str, kind: Column, normal: Column, title: Column, attempt: Column) -> Column:
    """Surrogate of an entity in normal form; later attempts widen the space where a format is narrow."""
    hexed = digest(key, kind, normal, attempt.cast("string"))
    wide = attempt >= 6
    tail = F.when(wide, F.array_join(F.transform(F.sequence(F.lit(6), F.greatest(attempt, F.lit(6))), lambda i: pick("23456789", number(hexed, i + 100))), "")).otherwise("")
    local, domain = F.split_part(normal, F.lit("@"), F.lit(1)), F.split_part(normal, F.lit("@"), F.lit(2))
    host, top = F.regexp_extract(domain, r"^(.*)(\.[^.]*)$", 1), F.regexp_extract(domain, r"(\.[^.]*)$", 1)
    email = F.concat(redraw(local, hexed), tail, F.lit("@"), redraw(host, digest(key, F.lit("host"), host)), top)
    octets = F.split(normal, r"\.")
    ip = F.array_join(F.transform(octets, lambda p, i: octet(p, number(hexed, i), wide)), ".")
    body = F.concat(F.substring(normal, 1, 1), redraw(F.expr("substring(normal, 2, length(normal) - 2)"), hexed))
    luhn = check_digit(F.expr("substring(normal, 1, length(normal) - 1)")) == F.expr("right(normal, 1)")
    card = F.concat(body, F.when(luhn, check_digit(body)).otherwise((number(hexed, 60) % 10).cast("string")), tail)
    head = F.when(normal.startswith("+"), F.substring(normal, 1, 2)).otherwise("")
    phone = F.concat(head, pick("23456789", number(hexed, 90)), redraw(F.expr("substring(normal, IF(startswith(normal, '+'), 4, 2))"), hexed), tail)
    iban = F.concat(F.substring(normal, 1, 2), redraw(F.expr("substring(normal, 3)"), hexed), tail)
    secret = F.concat(redraw(normal, hexed, normal.rlike("^[0-9a-f]+$")), tail)
    script = F.when(normal.rlike(r"\p{IsCyrillic}"), "cyrillic").otherwise("latin")
    name = F
    for (gender, letters), names in GIVEN.items():
        given, family = pick(names, number(hexed, 0)), pick(FAMILY[letters], number(hexed, 1))
        more = F.when(attempt > 1, F.concat(F.lit("-"), pick(FAMILY[letters], number(hexed, 2)))).otherwise("")
        most = F.when(attempt > 3, F.concat(F.lit("-"), pick(FAMILY[letters], number(hexed, 3)))).otherwise("")
        # From attempt 6 on each attempt adds a part, drawn from two bytes so that parts are not tied to one another.
        added = F.transform(F.sequence(F.lit(6), F.greatest(attempt, F.lit(6))), lambda i: F.concat(F.lit("-"), pick(FAMILY[letters], number(hexed, 2 * i) * 256 + number(hexed, 2 * i + 1))))
        most = F.concat(most, F.when(wide, F.array_join(added, "")).otherwise(""))
        whole = F.when(normal.contains(" "), F.concat(given, F.lit(" "), family, more, most)).otherwise(F.concat(family, more, most))
        name = name.when((F.when(title.rlike(FEMALE), "f").otherwise("m") == gender) & (script == letters), whole)
    return (F.when(kind == "email", email).when(kind == "ip", ip).when(kind == "card", card).when(kind == "phone", phone)
            .when(kind == "iban", iban).when(kind == "name", name).otherwise(secret))


def dressed(kind: Column, match: Column, value: Column, made: Column) -> Column:
    """The surrogate in the spelling of the match: its separators, its case, its label or title."""
    head = F.expr("substring(match, 1, length(match) - length(value))")
    core = F.when(kind == "phone", F.regexp_replace(made, r"\D", "")).otherwise(made)
    slots = F.regexp_replace(value, r"[^\p{L}\p{N}]", "")
    filled = F.array_join(F.transform(F.split(value, ""), lambda c, i: F.when(c.rlike(r"[\p{L}\p{N}]"), F.substring(
        core, F.length(F.regexp_replace(F.substring(value, F.lit(1), i + 1), r"[^\p{L}\p{N}]", "")).cast("int"), F.lit(1))).otherwise(c)), "")
    spaced = F.concat(filled, F.substring(core, F.length(slots) + 1, F.length(core)))
    cased = F.when(value == F.upper(value), F.upper(made)).otherwise(made)
    return F.when(kind.isin("phone", "card", "ssn", "iban"), spaced).when(kind == "email", cased).otherwise(F.concat(head, made))


def entities(df: DataFrame, text: str = "text") -> DataFrame:
    """Distinct (kind, normal, title) of all texts; the title of a name is its smallest one."""
    found = df.select(F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(PATTERN), 0))).alias("match"))
    return _described(found).groupBy("kind", "normal").agg(F.min("title").alias("title"))


def _described(found: DataFrame) -> DataFrame:
    match = F.col("match")
    return (found.withColumn("kind", kind_of(match)).withColumn("value", value_of(F.col("kind"), match))
            .withColumn("normal", normal_of(F.col("kind"), F.col("value")))
            .withColumn("title", F.when(F.col("kind") == "name", F.regexp_extract(match, TITLE, 0)).otherwise("")))


def surrogate_table(found: DataFrame, key: str) -> DataFrame:
    """(kind, normal, made): one surrogate per entity, no two alike and none a real entity."""
    found = stored(found)
    real = found.select("kind", F.col("normal").alias("form"))
    waiting, accepted, attempt = found, None, 0
    while True:
        made = surrogate(key, F.col("kind"), F.col("normal"), F.col("title"), F.lit(attempt))
        tried = waiting.withColumn("made", made).withColumn("form", F.when(F.col("kind") == "name", F.lower("made")).otherwise(F.col("made")))
        free = tried.join(real, ["kind", "form"], "left_anti")
        if accepted is not None:
            free = free.join(accepted.select("kind", "form"), ["kind", "form"], "left_anti")
        first = Window.partitionBy("kind", "form").orderBy("normal")
        won = stored(free.withColumn("turn", F.row_number().over(first)).where("turn = 1").select("kind", "normal", "made", "form"))
        accepted = won if accepted is None else accepted.unionByName(won)
        waiting = stored(waiting.join(won.select("kind", "normal"), ["kind", "normal"], "left_anti"))
        if waiting.isEmpty():
            return accepted.select("kind", "normal", "made")
        attempt += 1


def replace(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``df`` with surrogates in column ``text`` and new columns ``n_entities`` and ``kinds``.

    Every row gives one row, repeated rows too. Texts without entities, empty and null texts stay
    as they are with ``n_entities`` 0. Columns named ``n_entities`` or ``kinds`` are replaced; all
    others stay. Equal entities get equal surrogates in all rows, different ones different.
    """
    own = [c for c in df.columns if c not in ("n_entities", "kinds")]
    docs = df.select(*own)
    hit = F.coalesce(F.col(text).rlike(HINT) & F.col(text).rlike(PATTERN), F.lit(False))
    clean = docs.where(~hit).withColumns({"n_entities": F.lit(0), "kinds": F.array().cast("array<string>")})
    dirty = docs.where(hit)
    table = surrogate_table(entities(dirty, text), key)
    # Other columns travel with the first piece of their row, under names that can't clash.
    others = {c: f"__own{i}" for i, c in enumerate(own) if c != text}
    pieces = dirty.select(F.monotonically_increasing_id().alias("__row"), *(F.col(f"`{c}`").alias(n) for c, n in others.items()),
                          F.split(text, PATTERN, -1).alias("__parts"), F.regexp_extract_all(text, F.lit(PATTERN), 0).alias("__found"))
    zipped = F.transform("__parts", lambda p, i: F.struct(p.alias("part"), F.get("__found", i).alias("match")))
    rows = pieces.select("__row", *others.values(), F.posexplode(zipped).alias("__at", "__piece"))
    rows = rows.select("__row", "__at", *(F.when(F.col("__at") == 0, F.col(n)).alias(n) for n in others.values()), "__piece.part", "__piece.match")
    named = _described(rows).join(table, ["kind", "normal"], "left")
    new = F.coalesce(dressed(F.col("kind"), F.col("match"), F.col("value"), F.col("made")), F.lit(""))
    piece = F.struct("__at", F.concat("part", F.when(F.col("match").isNull(), "").otherwise(new)).alias("text"))
    whole = named.groupBy("__row").agg(
        *(F.first(n, ignorenulls=True).alias(n) for n in others.values()),
        F.array_join(F.transform(F.array_sort(F.collect_list(piece)), lambda p: p["text"]), "").alias("__text"),
        (F.count("match")).cast("int").alias("n_entities"),
        F.array_sort(F.collect_set(F.when(F.col("match").isNotNull(), F.col("kind")))).alias("kinds"))
    back = [F.col("__text").alias(c) if c == text else F.col(others[c]).alias(c) for c in own]
    return whole.select(*back, "n_entities", "kinds").unionByName(clean)
