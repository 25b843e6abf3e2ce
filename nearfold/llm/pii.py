r"""Personal data: keyed, type-consistent surrogates (DataFrame functions only).

Entities are found by one pattern per type.  Mentions of one entity (mail
addresses that differ in case, telephone numbers that differ in spacing) have
one normal form; each distinct (type, normal form) gets a surrogate drawn
from SHA-256 over a secret key, so the same entity has the same surrogate
everywhere (coreference).  A person is known by name, whatever the title; the
gender is taken once per person from all titles that state one, and the full
name of a titled person is replaced in the rest of the same text as well.
Surrogates of two entities that collide, or that
equal some entity of the table, are drawn again with the next attempt number
until none is left (distinctness); names grow by a family name with every
attempt, so no number of people uses them up.  A mention is then rendered in
the format of the original: separators, case, title and script are kept.

*   mail address: letters and digits drawn one by one, a reserved domain;
*   telephone, IPv4 and IPv6 address, card number (Luhn-valid where the original
    is), IBAN-like account, social security number: digits drawn, layout kept;
    telephone numbers are ``+`` and 8 to 15 digits in groups, 9 to 12 digits in
    groups behind a 0, groups of the North American form, or ten digits in a
    row that begin with 2 to 9;
*   secret (``name = "..."`` or a long hex run): hex or letters of the same
    length and case;
*   person after a title (``Mr``, ``Frau``, ``Señora``, ``г-н`` ...): names of
    the person's gender in the name's script (Latin, Cyrillic, Greek, Han).

Every pattern is bounded: a repeat within a repeat has fixed limits, and an
open-ended one is possessive or begins where a run begins.  So the time is
linear in the text and the matcher's stack does not grow with it.

Distinct entities, not documents, meet in the surrogate table; mentions are
counted once per document and entity before they are joined to it.

Defined results: null and empty texts stay as they are; a text without
entities is returned unchanged; repeated rows give repeated results; empty
tables give no rows; texts of any length are searched whole; other columns
are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfold.llm.common import staged

#: Given and family names by script and gender.
NAMES = {
    "latin": {
        "f": "Anna Clara Elena Greta Helen Irene Julia Karin Laura Maria Nora Olga Paula Rosa Sofia Vera".split(),
        "m": "Adam Bruno Conrad David Emil Felix Hugo Ivan Jonas Karl Leon Martin Oscar Paul Simon Victor".split(),
        "family": "Adler Berger Costa Duval Engel Ferrer Garner Holm Iversen Jansen Keller Lindt Moreno Novak Olsen Peters".split(),
    },
    "cyrillic": {
        "f": "Анна Вера Галина Дарья Елена Инна Мария Ольга".split(),
        "m": "Антон Борис Виктор Глеб Денис Иван Олег Павел".split(),
        "family": "Беленко Гнатюк Довженко Иваненко Коваль Левченко Мороз Шевчук".split(),
    },
    "greek": {
        "f": "Άννα Δάφνη Ελένη Ιωάννα Μαρία Νίκη Σοφία Χλόη".split(),
        "m": "Αλέξης Γιώργος Δημήτρης Ηλίας Κώστας Νίκος Πέτρος Στέλιος".split(),
        "family": "Γαλάνη Δούκα Ζαχαρίου Ιωάννου Κωνσταντίνου Λάμπρου Μακρή Νικολάου".split(),
    },
    "han": {
        "f": "芳 娜 敏 静 丽 艳 娟 霞".split(),
        "m": "伟 强 磊 军 勇 杰 涛 明".split(),
        "family": "王 李 张 刘 陈 杨 赵 黄".split(),
    },
}
#: Titles and the gender they state.
TITLES = {"f": ("Mrs", "Ms", "Miss", "Frau", "Señora", "Sra", "Madame", "Mme", "г-жа", "κα"), "m": ("Mr", "Herr", "Señor", "Sr", "Monsieur", "г-н", "κος"), "n": ("Dr", "Prof")}

_TITLE = "|".join(t for g in TITLES.values() for t in g)
_NAME = r"\p{Lu}[\p{L}'’-]{1,40}+"
_WORD = r"\p{L}\p{N}"
_LOCAL = rf"[{_WORD}._%+'-]"
_HEX = "[0-9A-Fa-f]"
#: Patterns by type; an earlier type wins where two begin at the same place.  None has groups of its own.
PATTERNS: dict[str, str] = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@(?:[{_WORD}][{_WORD}-]{{0,62}}+\.){{1,10}}\p{{L}}{{2,24}}+",
    "secret": r"(?i:\b(?:token|secret|passw(?:or)?d|api[_-]?key|access[_-]?key)\b)['\"]?\s{0,3}[=:]\s{0,3}['\"]?[A-Za-z0-9_+/.=-]{12,}+|(?<![\p{L}\p{N}])(?:(?=[0-9]{0,128}+[a-f])(?=[a-f]{0,128}+[0-9])[0-9a-f]{32,128}+|AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36})(?![\p{L}\p{N}])",
    "ip": r"(?<![\p{N}.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\p{N}]|\.\d)",
    "ip6": rf"(?<![{_WORD}:.])(?=(?:{_HEX}{{1,4}}:){{7}}|{_HEX}{{0,4}}(?::{_HEX}{{1,4}}){{0,6}}::)(?=[A-Fa-f:]{{0,39}}+[0-9])(?:{_HEX}{{0,4}}:){{2,7}}{_HEX}{{0,4}}+(?![{_WORD}:])",
    "iban": r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "ssn": r"(?<![\p{N}-])\d{3}-\d{2}-\d{4}(?![\p{N}-])",
    "card": r"(?<![\p{N}-])\d(?:[ -]?\d){12,18}(?![\p{N}-])",
    "phone": r"(?<![\p{N}+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{3,4}[ .-]\d{3,4}(?!\p{N})"
    r"|(?<![\p{N}+])\+(?=(?:[ .()/-]{0,2}\d){8,15}(?!\p{N}))\d{1,3}(?:[ .()/-]{0,2}\d{1,12}){1,6}(?!\p{N})"
    r"|(?<![\p{N}+.,/-])(?=(?:[ /-]?\d){9,12}(?![ /-]?\p{N}))0\d{1,4}(?:[ /-]\d{2,8}){1,4}(?!\p{N})"
    r"|(?<![\p{L}\p{N}+.,/-])[2-9]\d{9}(?![\p{L}\p{N}]|[.,/-]\d)",
    "person": rf"(?<!\p{{L}})(?:{_TITLE})\.?(?:[ \u00a0]{_NAME}(?:[ \u00a0]{_NAME}){{0,2}}|[ \u00a0]?\p{{IsHan}}{{2,4}}+)",
}
#: All types in one pattern.
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())

KEY = "replace this key in production"


def kind_of(mention: Column) -> Column:
    """The type of a mention: the first pattern that matches it whole."""
    return reduce(lambda otherwise, t: F.when(mention.rlike(f"^(?:{PATTERNS[t]})$"), F.lit(t)).otherwise(otherwise), reversed(PATTERNS), F.lit("other"))


def _body(kind: Column, mention: Column) -> Column:
    """The part of a mention that is replaced: a secret's value, a person's name, else all of it."""
    value = F.regexp_extract(mention, r"""^(?:[A-Za-z_-]+['"]?\s*[=:]\s*['"]?)?(.*)$""", 1)
    name = F.regexp_extract(mention, rf"^(?:{_TITLE})\.?[ \u00a0]?(.*)$", 1)
    return F.when(kind == "secret", value).when(kind == "person", name).otherwise(mention)


def normal_form(kind: Column, mention: Column) -> Column:
    """Equal for mentions of one entity."""
    body = _body(kind, mention)
    return (
        F.when(kind.isin("email", "ip6"), F.lower(body))
        .when(kind.isin("card", "phone", "ssn"), F.regexp_replace(body, r"\D", ""))
        .when(kind == "iban", F.replace(body, F.lit(" "), F.lit("")))
        .when(kind == "person", F.regexp_replace(F.lower(body), "\u00a0", " "))
        .otherwise(body)
    )


def stated_gender(mention: Column) -> Column:
    """f or m where the mention's title states it, else null."""
    title = F.regexp_extract(mention, rf"^({_TITLE})", 1)
    return F.when(title.isin(*TITLES["f"]), F.lit("f")).when(title.isin(*TITLES["m"]), F.lit("m"))


def entities_of(mentions: DataFrame) -> DataFrame:
    """``kind, norm, gender``: every entity once; a person's gender is n where titles state none or both."""
    stated = F.when(F.col("kind") == "person", stated_gender(F.col("mention")))
    one = mentions.groupBy("kind", "norm").agg(F.min(stated).alias("_a"), F.max(stated).alias("_b"))
    return one.select("kind", "norm", F.when(F.col("_a") == F.col("_b"), F.col("_a")).otherwise(F.lit("n")).alias("gender"))


def _hex(key: str, attempt: Column) -> Column:
    """1,024 keyed hex digits for an entity and an attempt."""
    seed = lambda i: F.sha2(F.concat_ws("|", F.lit(key), F.lit(str(i)), F.col("kind"), F.col("norm"), attempt.cast("string")), 512)
    return F.concat(*[seed(i) for i in range(8)])


def _byte(at: Column) -> Column:
    """Number 0 .. 65535 from the drawn digits, by position (used again beyond 256 positions)."""
    return F.conv(F.substring(F.col("_draw"), (F.pmod(at, F.lit(255)) * 4 + 1).cast("int"), F.lit(4)), 16, 10).cast("int")


_LOWER, _UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _redraw(text: Column, keep: int = 0, letters: tuple[str, str] = (_LOWER, _UPPER)) -> Column:
    """Every digit and letter drawn anew, its class and case kept; the first ``keep`` characters stay."""

    def one(c: Column, i: Column) -> Column:
        pick = lambda letters: F.substring(F.lit(letters), (F.pmod(_byte(i), F.lit(len(letters))) + 1).cast("int"), F.lit(1))
        return (
            F.when(i < keep, c)
            .when(c.rlike(r"^\d$"), pick("0123456789"))
            .when(c.rlike(r"^\p{Lu}$"), pick(letters[1]))
            .when(c.rlike(r"^\p{L}$"), pick(letters[0]))
            .otherwise(c)
        )

    return F.array_join(F.transform(F.split(text, ""), one), "")


def _luhn(digits: Column) -> Column:
    """Luhn sum of a digit string, modulo 10."""
    d = F.transform(F.reverse(F.split(digits, "")), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(d, F.lit(0), lambda a, x: a + x) % 10


def surrogate() -> Column:
    """Normal form of the surrogate for ``kind``, ``norm`` and the drawn digits ``_draw``."""
    norm, kind = F.col("norm"), F.col("kind")
    local = F.regexp_extract(norm, "^(.*)@", 1)
    email = F.concat(_redraw(local), F.lit("@"), _redraw(F.lit("mailab")), F.lit(".example."), F.when(_byte(F.lit(250)) % 2 == 0, F.lit("org")).otherwise(F.lit("net")))
    octet = lambda i: (F.pmod(_byte(F.lit(i)), F.lit(254)) + 1).cast("string")
    ip = F.concat_ws(".", *[octet(i) for i in range(4)])
    drawn = _redraw(norm, keep=1)
    stem = F.substring(drawn, F.lit(1), F.length(drawn) - 1)
    check = (10 - _luhn(F.concat(stem, F.lit("0")))) % 10
    card = F.when(_luhn(norm) == 0, F.concat(stem, check.cast("int").cast("string"))).otherwise(drawn)
    country = F.when(F.length(norm) > 10, F.length(norm) - 10).otherwise(0)
    phone = F.concat(F.substring(norm, F.lit(1), country.cast("int")), _redraw(F.substring(norm, (country + 1).cast("int"), F.length(norm))))
    iban = F.concat(F.substring(norm, 1, 2), _redraw(F.substring(norm, F.lit(3), F.length(norm))))
    hexed = _redraw(norm, letters=("abcdef", "ABCDEF"))
    # A value of marks alone has nothing to draw, one of few letters runs out of draws: from the third attempt on its marks are drawn too.
    marks = _redraw(F.when(F.col("attempt") > 1, F.regexp_replace(norm, "[^A-Za-z0-9]", "x")).otherwise(norm))
    secret = F.when(norm.rlike("^[0-9a-fA-F]+$"), hexed).otherwise(marks)
    script = (
        F.when(norm.rlike(r"\p{IsCyrillic}"), F.lit("cyrillic")).when(norm.rlike(r"\p{IsGreek}"), F.lit("greek"))
        .when(norm.rlike(r"\p{IsHan}"), F.lit("han")).otherwise(F.lit("latin"))
    )
    gender = F.col("gender")
    parts = F.size(F.split(norm, " "))

    def name(table: str, g: str, at: Column) -> Column:
        pool = NAMES[table]["f"] + NAMES[table]["m"] if g == "n" else NAMES[table][g]
        return F.element_at(F.array(*[F.lit(x) for x in pool]), (F.pmod(_byte(at), F.lit(len(pool))) + 1).cast("int"))

    def person(table: str) -> Column:
        given = lambda i: F.when(gender == "f", name(table, "f", F.lit(i))).when(gender == "m", name(table, "m", F.lit(i))).otherwise(name(table, "n", F.lit(i)))
        # One more family name with every attempt, so names do not run out.
        family = F.array_join(F.transform(F.sequence(F.lit(0), F.col("attempt")), lambda i: name(table, "family", i * 2 + 9)), "-")
        return F.when(parts == 1, family).when(parts == 2, F.concat_ws(" ", given(3), family)).otherwise(F.concat_ws(" ", given(3), given(5), family))

    # A Han name is written without spaces, the family name first.
    given = F.array_join(F.transform(F.sequence(F.lit(0), F.col("attempt")), lambda i: F.when(gender == "f", name("han", "f", i * 2 + 9)).when(gender == "m", name("han", "m", i * 2 + 9)).otherwise(name("han", "n", i * 2 + 9))), "")
    who = F.when(script == "han", F.concat(name("han", "family", F.lit(3)), given)).when(script == "cyrillic", person("cyrillic")).when(script == "greek", person("greek")).otherwise(person("latin"))
    return (
        F.when(kind == "email", email).when(kind == "ip", ip).when(kind == "card", card).when(kind == "phone", phone)
        .when(kind == "iban", iban).when(kind == "ip6", hexed).when(kind == "secret", secret).when(kind == "person", who).otherwise(_redraw(norm))
    )


def _as_norm() -> Column:
    """A surrogate in the form in which entities are compared."""
    return F.when(F.col("kind") == "person", F.lower("sur")).otherwise(F.col("sur"))


def surrogates(entities: DataFrame, key: str = KEY) -> DataFrame:
    """``kind, norm, sur``: a distinct surrogate for every ``kind, norm`` of ``entities`` (with ``gender``).

    Each round draws again for entities whose surrogate another entity holds
    (the smallest normal form of those on the lowest attempt keeps it) or
    which equals an entity of the table."""
    draw = lambda df: df.withColumn("_draw", _hex(key, F.col("attempt"))).withColumn("sur", surrogate()).drop("_draw")
    taken = entities.select("kind", F.col("norm").alias("_s"))
    table = staged(draw(entities.select("kind", "norm", "gender").withColumn("attempt", F.lit(0))), "surrogates")
    while True:
        named = table.withColumn("_s", _as_norm())
        holder = named.groupBy("kind", "_s").agg(F.min(F.struct("attempt", "norm")).alias("_first"), F.count(F.lit(1)).alias("_n"))
        clash = holder.where("_n > 1").join(taken.withColumn("_real", F.lit(True)), ["kind", "_s"], "left").select("kind", "_s", "_first", "_real")
        alone = holder.where("_n = 1").join(taken, ["kind", "_s"], "left_semi").select("kind", "_s", "_first", F.lit(True).alias("_real"))
        again = (
            named.join(clash.union(alone), ["kind", "_s"])
            .where(F.col("_real").isNotNull() | (F.struct("attempt", "norm") != F.col("_first")))
            .select("kind", "norm", "gender", (F.col("attempt") + 1).alias("attempt"))
        )
        again = staged(draw(again), "surrogates_again")
        if not again.limit(1).count():
            return table.select("kind", "norm", "sur")
        table = staged(table.join(again.select("kind", "norm"), ["kind", "norm"], "left_anti").unionByName(again), "surrogates")


def render(kind: Column, mention: Column, sur: Column) -> Column:
    """A surrogate in the format of the mention it stands for."""
    body = _body(kind, mention)
    # Digits (and for accounts letters) of the surrogate take the places of the mention's.
    slot = F.when(kind == "iban", F.lit("[A-Z0-9]")).otherwise(F.lit("[0-9]"))
    chars = F.split(body, "")
    laid = F.array_join(
        F.transform(
            chars,
            lambda c, i: F.when(
                F.regexp_like(c, slot), F.substring(sur, (F.regexp_count(F.substring(body, F.lit(1), (i + 1).cast("int")), slot)).cast("int"), F.lit(1))
            ).otherwise(c),
        ),
        "",
    )
    shout = F.when((body == F.upper(body)) & (body != F.lower(body)), F.upper(sur))
    new = (
        F.when(kind.isin("card", "phone", "ssn", "iban"), laid)
        .when(kind == "email", F.coalesce(shout, F.when(body.rlike(r"^\p{Lu}"), F.concat(F.upper(F.substring(sur, 1, 1)), F.substring(sur, F.lit(2), F.length(sur)))), sur))
        .when(kind.isin("person", "ip6"), F.coalesce(shout, sur))
        .otherwise(sur)
    )
    lead = F.substring(mention, F.lit(1), F.length(mention) - F.length(body))
    return F.concat(lead, new)


def mentions_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(ANY), F.lit(0))


def _has_pii(text: Column) -> Column:
    """True where a text holds an entity; texts without what every pattern needs are told at once."""
    hint = rf"[@0-9]|(?i:token|secret|passw|key)|AKIA|gh[pousr]_|(?:{_TITLE})"
    return F.coalesce(text.rlike(hint) & text.rlike(ANY), F.lit(False))


def _bare(name: Column) -> Column:
    """Pattern of a person's full name without a title."""
    return F.concat(F.lit(r"(?<![\p{L}'’-])\Q"), name, F.lit(r"\E(?![\p{L}'’-])"))


def replace_pii(docs: DataFrame, key: str = KEY) -> DataFrame:
    """``doc_id, text, n_entities``: texts with surrogates, and the number of mentions replaced.

    One pass over the table stores the texts that hold entities with their
    mentions; all later steps read only these."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    held = rows.where(_has_pii(F.col("text"))).select("*", F.xxhash64("doc_id", "text").alias("_row"), mentions_of(F.col("text")).alias("_found"))
    held = staged(held, "pii_texts")
    mentions = held.select("_row", F.explode(F.array_distinct("_found")).alias("mention")).distinct()
    mentions = mentions.withColumn("kind", kind_of(F.col("mention"))).withColumn("norm", normal_form(F.col("kind"), F.col("mention")))
    mentions = staged(mentions, "pii_mentions")
    table = surrogates(entities_of(mentions), key)
    kind, mention, sur = F.col("kind"), F.col("mention"), F.col("sur")
    body = _body(kind, mention)
    full = F.when((kind == "person") & body.contains(" "), F.struct(body.alias("name"), F.when((body == F.upper(body)) & (body != F.lower(body)), F.upper(sur)).otherwise(sur).alias("new")))
    swaps = mentions.join(table, ["kind", "norm"]).select("_row", "mention", render(kind, mention, sur).alias("new"), full.alias("full"))
    swaps = swaps.groupBy("_row").agg(
        F.map_from_entries(F.collect_list(F.struct("mention", "new"))).alias("_new"), F.array_sort(F.collect_set("full")).alias("_full")
    )
    # Only texts with entities are shuffled.
    put = F.transform("_found", lambda m: F.coalesce(F.try_element_at("_new", m), m))
    done = F.array_join(F.zip_with(F.split("text", ANY, -1), put, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    changed = held.join(swaps, "_row").select("doc_id", done.alias("_text"), F.size("_found").alias("_n"), "_full")
    # The full names of titled persons in the rest of their text; no surrogate equals one of them.
    names = F.aggregate("_full", F.col("_text"), lambda t, e: F.regexp_replace(t, _bare(e["name"]), e["new"]))
    more = F.aggregate("_full", F.lit(0), lambda n, e: n + F.regexp_count("_text", _bare(e["name"])))
    changed = changed.select("doc_id", names.alias("text"), (F.col("_n") + more).alias("n_entities"))
    return changed.unionByName(rows.where(~_has_pii(F.col("text"))).withColumn("n_entities", F.lit(0)))
