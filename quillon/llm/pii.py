"""Surrogates for personal data (operator 10): DataFrame functions only.

Detected entities are replaced by surrogates of the same kind and format, derived from a keyed
digest of the entity's canonical form: the same entity gets the same surrogate in
every document and every way of writing it. Phone numbers keep the country code and punctuation, cards the
issuer digit and a valid check digit, addresses the domain ending, secrets their name and alphabet,
names the title or the words that introduce them, the gender and the script.

A name is made of two parts: the surname's surrogate hangs on the surname alone, so that a person is the same with
and without a given name, the given name's on the whole name and the gender. In a document that introduces a
person, that name is replaced where it stands alone too.

Distinct entities must have distinct surrogates, none of which is an entity of the corpus. All distinct
entities are checked for that; those that collide, all but the smallest, draw again with the next attempt number
until none collides. Later attempts draw from wider spaces. Attempt 0 is computed in place; only entities with a later
attempt travel to the documents that hold them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import materialize, shuffle_width, table

MEN = ["Mr.", "Mr", "Herr", "Monsieur", "Señor", "г-н", "Κύριος", "κ."]
WOMEN = ["Mrs.", "Mrs", "Ms.", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "г-жа", "Κυρία", "κα"]
#: Titles and words that introduce a person without telling the gender.
CUES = ["Dr.", "Prof.", "my name is", "My name is", "mein Name ist", "Mein Name ist", "je m'appelle", "Je m'appelle", "me llamo", "Me llamo", "меня зовут", "Меня зовут", "με λένε", "Με λένε"]
GIVEN_MEN = ["Adrian", "Bruno", "Carl", "Daniel", "Emil", "Felix", "Gustav", "Hugo", "Ivan", "Jonas", "Karim", "Lukas", "Martin", "Noel", "Oscar", "Paul"]
GIVEN_WOMEN = ["Alma", "Berta", "Clara", "Dora", "Elena", "Frida", "Greta", "Helena", "Irene", "Julia", "Karla", "Laura", "Marta", "Nora", "Olga", "Paula"]
SYLLABLES = ["ba", "der", "fin", "gol", "har", "kem", "lan", "mor", "nel", "os", "per", "rin", "sal", "tor", "vel", "wen"]
_TITLES = "|".join(x.replace(".", r"\.") for x in sorted(MEN + WOMEN + CUES, key=len, reverse=True))
_SECRET = r"(?:password|passwd|pwd|passphrase|token|secret|api[_-]?key|access[_-]?key)"
#: A name to its end: inner capitals, hyphens and apostrophes belong to it, a possessive ending doesn't.
_NAME = r"\p{Lu}(?:[\p{L}\p{M}]|-(?=\p{L})|['’](?=\p{L})(?!s(?!\p{L})))+"
PATTERNS = [
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[0-9A-Z]{16}(?![A-Za-z0-9])",
    rf"(?<![A-Za-z0-9])(?i:{_SECRET})\s*[=:]\s*[\"']?[A-Za-z0-9_/+.\-]{{6,}}",
    r"(?<![A-Za-z0-9])(?:gh[pousr]_[A-Za-z0-9]{20,}|sk-[A-Za-z0-9_-]{16,}|xox[abp]-[A-Za-z0-9-]{10,})",
    r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?!\.?[0-9])",
    r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    r"(?<![0-9])[0-9]{4}(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{1,7}(?![0-9])",
    r"(?<![0-9A-Za-z])3[47][0-9]{2}[ -]?[0-9]{6}[ -]?[0-9]{5}(?![0-9])",
    r"\+[0-9]{1,3}[ .-]?(?:\([0-9]{3}\)|[0-9]{3})[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])",
    r"\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .-]?[0-9]{2,4}){2,4}(?!\.?[0-9])",
    r"(?<![0-9A-Za-z])(?:\([0-9]{3}\) ?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9])",
    rf"(?<!\p{{L}})(?:{_TITLES})\s+{_NAME}(?: (?:\p{{Lu}}\. )?{_NAME})?",
]
ENTITY = "|".join(PATTERNS)
#: No entity is found in a text without one of these.
HINT = rf"[0-9@=:]|(?:{_TITLES})\s|AKIA|ASIA|gh[pousr]_|sk-|xox[abp]-"
#: After so many attempts what still collides gets a surrogate with a digest behind it: the format gives way.
ATTEMPTS = 32
#: The country code at the start of an international number's digits.
COUNTRY = "^(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"
_LOWER, _UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_CYR, _CYR_UP = "абвгдежзиклмнопрстуфхцчшэюя", "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ"
_GREEK, _GREEK_UP = "αβγδεζηθικλμνξοπρστυφχψω", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ"
_ARMENIAN = "".join(map(chr, range(0x561, 0x586)))
#: Cased scripts other than Latin whose names keep their script; names in further ones become Latin.
SCRIPTS = {"Cyrillic": (_CYR, _CYR_UP), "Greek": (_GREEK, _GREEK_UP), "Armenian": (_ARMENIAN, _ARMENIAN.upper())}


def kind_of(e: Column) -> Column:
    return (
        F.when(e.contains("@"), "email").when(e.rlike(rf"^(?i:{_SECRET})\s*[=:]"), "secret").when(e.rlike("^(?:AKIA|ASIA)[0-9A-Z]{16}$"), "cloud_key").when(e.rlike("^(?:gh[pousr]_|sk-|xox[abp]-)"), "secret")
        .when(e.rlike(r"^(?:[0-9]{1,3}\.){3}[0-9]{1,3}$"), "ip").when(e.rlike("^[A-Z]{2}[0-9]{2}"), "iban").when(e.rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), "ssn")
        .when(F.length(F.regexp_replace(e, "[^0-9]", "")).between(13, 19) & e.rlike("^[0-9]"), "card").when(e.rlike(r"^[+(0-9]"), "phone").otherwise("person")
    )


def head_of(e: Column, kind: Column) -> Column:
    """What a surrogate keeps: a secret's name, a title, the first letters of a key."""
    return F.when(kind == "secret", F.regexp_extract(e, rf"^(?:(?i:{_SECRET})\s*[=:]\s*[\"']?|gh[pousr]_|sk-|xox[abp]-)", 0)).when(kind == "person", F.regexp_extract(e, rf"^(?:{_TITLES})\s+", 0)).when(kind == "cloud_key", F.substring(e, 1, 4)).when(kind == "iban", F.substring(e, 1, 2)).otherwise(F.lit(""))


#: Added to the attempt of a whole name whose titles say another gender than its ending.
OTHER = 1 << 16


def first_of(name: Column) -> Column:
    return F.element_at(F.split(name, " "), 1)


def is_woman(given: Column) -> Column:
    """By the ending of a given name."""
    return F.coalesce(F.lower(given).rlike("[aаяαηա]$"), F.lit(False))


def told_otherwise(seen: DataFrame) -> DataFrame:
    """(name) of the whole names whose titles in the corpus, where these agree, say another gender than their ending."""
    title = F.regexp_replace(F.col("x.head"), r"\s+$", "")
    told = seen.where((F.col("x.kind") == "person") & F.col("x.body").contains(" ")).groupBy(F.col("x.name").alias("name")).agg(F.max(title.isin(WOMEN)).alias("woman"), F.max(title.isin(MEN)).alias("man"))
    return told.where((F.col("woman") != F.col("man")) & (F.col("woman") != is_woman(first_of(F.col("name"))))).select("name")


def canon(e: Column, kind: Column, head: Column, body: Column) -> Column:
    """The form that all ways to write an entity share; of a person first and last name, of a number with an area code in brackets the one of its country."""
    digits = F.regexp_replace(e, "[^0-9]", "")
    person = F.lower(F.when(body.contains(" "), F.concat(first_of(body), F.lit(" "), F.element_at(F.split(body, " "), -1))).otherwise(body))
    return F.when(kind.isin("card", "ssn"), digits).when(kind == "phone", F.concat(F.when(e.startswith("+"), "+").otherwise("+1"), digits)).when(kind == "iban", F.regexp_replace(e, " ", "")).when(kind == "email", F.lower(body)).when(kind == "person", person).otherwise(body)


def _byte(digest: Column, i: Column) -> Column:
    """Byte ``i`` (from 1, around after 64) of a digest in hexadecimal."""
    return F.conv(F.substring(digest, (F.pmod(i - 1, F.lit(64)) * 2 + 1).cast("int"), F.lit(2)), 16, 10).cast("int")


def _pick(letters: str, n: Column) -> Column:
    return F.substring(F.lit(letters), (n % len(letters) + 1).cast("int"), F.lit(1))


def _each(value: Column, one) -> Column:
    """``value`` with each character changed by ``one(character, place)``; bytes of digests repeat after 64 places."""
    return F.when(F.length(value) > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.length(value)), lambda i: one(F.substring(value, i, F.lit(1)), i)), "")).otherwise(F.lit(""))


def _shaped(value: Column, digest: Column, hexes: Column) -> Column:
    """Each ASCII letter and digit of ``value`` changed for one of its kind; ``hexes``: letters a-f stay hexadecimal."""

    def one(c: Column, i: Column) -> Column:
        n = _byte(digest, i)
        return (
            F.when(c.rlike("[0-9]"), _pick("0123456789", n)).when(hexes & c.rlike("[a-f]"), _pick("abcdef", n)).when(hexes & c.rlike("[A-F]"), _pick("ABCDEF", n))
            .when(c.rlike("[a-z]"), _pick(_LOWER, n)).when(c.rlike("[A-Z]"), _pick(_UPPER, n)).otherwise(c)
        )

    return _each(value, one)


def _spaced(fresh: Column, value: Column) -> Column:
    """``fresh`` with the spaces of ``value``, whose other characters it has one for one."""
    at = lambda i: F.length(F.replace(F.substring(value, F.lit(1), i), F.lit(" "), F.lit("")))
    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(value)), lambda i: F.when(F.substring(value, i, F.lit(1)) == " ", " ").otherwise(F.substring(fresh, at(i), F.lit(1)))), "")


def _numbers(e: Column, kind: Column, digest: Column, attempt: Column) -> Column:
    """A number in the format of ``e``: punctuation, country code and issuer digit stay, a card's check digit is right."""
    digits = F.regexp_replace(e, "[^0-9]", "")
    n = F.length(digits)
    kept = F.when(kind == "card", 1).when(e.startswith("+"), F.length(F.regexp_extract(digits, COUNTRY, 0))).otherwise(0)
    ahead = F.when((kind == "phone") & ~e.startswith("+"), 1).otherwise(0)  # the country code that isn't written
    fresh = F.transform(F.sequence(F.lit(1), n), lambda i: F.when(i <= kept, F.substring(digits, i, F.lit(1)).cast("int")).when((i == kept + 1) & (kind == "phone"), _byte(digest, i + ahead) % 8 + 2).otherwise(_byte(digest, i + ahead) % 10))
    # the check digit: of the others, from the right, each first is doubled
    doubled = F.transform(F.slice(fresh, 1, F.greatest(n - 1, F.lit(1))), lambda d, i: F.when(F.pmod(n - i, F.lit(2)) == 0, F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)).otherwise(d))
    check = F.pmod(-F.aggregate(doubled, F.lit(0), lambda a, d: a + d), F.lit(10))
    fresh = F.when(kind == "card", F.concat(F.slice(fresh, 1, F.greatest(n - 1, F.lit(1))), F.array(check))).otherwise(fresh)
    at = lambda i: F.length(F.regexp_replace(F.substring(e, F.lit(1), i), "[^0-9]", ""))
    written = F.array_join(F.transform(F.sequence(F.lit(1), F.length(e)), lambda i: F.when(F.substring(e, i, F.lit(1)).rlike("[0-9]"), F.get(fresh, at(i) - 1).cast("string")).otherwise(F.substring(e, i, F.lit(1)))), "")
    # short international numbers grow to nine free digits
    more = F.substring(_more(list("0123456789"), digest, F.lit(9)), F.lit(1), F.least(wider(attempt) * 3, 9 - (n - kept)))
    return F.when((kind == "phone") & e.startswith("+") & (attempt > 3) & (n - kept < 9), F.concat(written, more)).otherwise(written)


def wider(attempt: Column) -> Column:
    """How often the space of surrogates has been widened: once every four attempts."""
    return F.floor(attempt / 4).cast("int")


def _more(pieces: list[str], digest: Column, n: Column) -> Column:
    """``n`` further pieces, of bytes that nothing else is drawn from."""
    other = F.transform(F.array(F.sha2(F.concat(digest, F.lit("more")), 512)), lambda d: F.array_join(F.transform(F.sequence(F.lit(1), n), lambda i: F.element_at(F.array(*map(F.lit, pieces)), _byte(d, i) % len(pieces) + 1)), ""))
    return F.when(n > 0, F.element_at(other, 1)).otherwise(F.lit(""))


def _in_script(word: Column, digest: Column, attempt: Column, latin: Column) -> Column:
    """A name in the script of ``word``: letter for letter, the ending kept, later with more letters before it; ``latin`` for all other scripts."""
    found = latin
    for script, (lower, upper) in SCRIPTS.items():
        one = lambda c, i, lower=lower, upper=upper: F.when(c.rlike(r"\p{Lu}"), _pick(upper, _byte(digest, i))).otherwise(_pick(lower, _byte(digest, i)))
        shaped = F.concat(_each(F.substring(word, F.lit(1), F.length(word) - 1), one), _more(list(lower), digest, wider(attempt) * 2), F.substring(word, F.length(word), F.lit(1)))
        found = F.when(word.rlike(rf"^\p{{Is{script}}}"), shaped).otherwise(found)
    return found


def _surname(word: Column, digest: Column, attempt: Column) -> Column:
    """Four syllables, in later attempts more."""
    syllable = lambda k: F.element_at(F.array(*map(F.lit, SYLLABLES)), _byte(digest, F.lit(k)) % 16 + 1)
    return _in_script(word, digest, attempt, F.initcap(F.concat(*map(syllable, range(2, 6)), _more(SYLLABLES, digest, wider(attempt) * 2))))


def _given(word: Column, female: Column, digest: Column, attempt: Column) -> Column:
    """One of few names of the gender; in later attempts syllables with an ending by the gender."""
    pick = lambda names: F.element_at(F.array(*map(F.lit, names)), _byte(digest, F.lit(1)) % 16 + 1)
    made = F.concat(F.initcap(_more(SYLLABLES, digest, wider(attempt) + 2)), F.when(female, "a").otherwise("o"))
    listed = F.when(female, pick(GIVEN_WOMEN)).otherwise(pick(GIVEN_MEN))
    return _in_script(word, digest, attempt, F.when(attempt > 0, made).otherwise(listed))


def looked_at(e: Column) -> list:
    """Steps that each add fields to an entity's struct, so that nothing is worked out twice."""
    return [
        lambda x: F.struct(x.alias("e"), kind_of(x).alias("kind")),
        lambda x: F.struct(x["e"].alias("e"), x["kind"].alias("kind"), head_of(x["e"], x["kind"]).alias("head")),
        lambda x: F.struct(x["e"].alias("e"), x["kind"].alias("kind"), x["head"].alias("head"), F.substring(x["e"], F.length(x["head"]) + 1, F.length(x["e"])).alias("body")),
        lambda x: F.struct(x["e"].alias("e"), x["kind"].alias("kind"), x["head"].alias("head"), x["body"].alias("body"), canon(x["e"], x["kind"], x["head"], x["body"]).alias("name")),
    ]


def described(found: Column) -> Column:
    """An array of entities as structs of e, kind, head, body and name."""
    for step in looked_at(found):
        found = F.transform(found, step)
    return found


def last_of(x: Column) -> Column:
    return F.element_at(F.split(x["body"], " "), -1)


def parts_of(x: Column) -> Column:
    """What is checked for collisions of an entity: itself, or of a person the surname, and the whole name if it has another part."""
    part = lambda e, kind, name: F.struct(e.alias("e"), F.lit(kind).alias("kind"), F.lit("").alias("head"), e.alias("body"), name.alias("name"))
    surname, given = part(last_of(x), "surname", F.lower(last_of(x))), part(x["body"], "given", x["name"])
    return F.when(x["kind"] != "person", F.array(x)).when(x["body"].contains(" "), F.array(surname, given)).otherwise(F.array(surname))


def digest_of(kind: Column, name: Column, attempt: Column, key: str) -> Column:
    return F.sha2(F.concat_ws("\x1f", F.lit(key), kind, name, attempt.cast("string")), 512)


def surrogate(x: Column, attempt, key: str) -> Column:
    """The surrogate of a struct of ``described``, or of a part; ``attempt(kind, name)`` gives the attempt of each part."""
    last, own = F.lower(last_of(x)), F.when(x["kind"] == "person", "given").otherwise(x["kind"])
    state = F.struct(x.alias("x"), attempt(own, x["name"]).alias("attempt"), F.when(x["kind"] == "person", attempt(F.lit("surname"), last)).alias("surname"))
    state = F.transform(F.array(state), lambda y: F.struct(y["x"].alias("x"), (y["attempt"] % OTHER).alias("attempt"), (y["attempt"] >= OTHER).alias("other"), y["surname"].alias("surname")))
    drawn = F.transform(state, lambda y: F.struct(y["x"].alias("x"), y["attempt"].alias("attempt"), (y["other"] != is_woman(first_of(x["name"]))).alias("woman"), digest_of(own, x["name"], y["attempt"], key).alias("digest"), y["surname"].alias("surname"), digest_of(F.lit("surname"), last, y["surname"], key).alias("surname_digest")))
    drawn = F.transform(drawn, lambda y: _drawn(y["x"], y["digest"], y["attempt"], y["woman"], y["surname_digest"], y["surname"]))
    return F.element_at(drawn, 1)


def _tail(digest: Column, attempt: Column) -> Column:
    return F.when(attempt >= ATTEMPTS, F.concat(F.lit("-"), F.substring(digest, 97, 32))).otherwise(F.lit(""))


def _drawn(x: Column, digest: Column, attempt: Column, woman: Column, surname_digest: Column, surname_attempt: Column) -> Column:
    e, kind, head, body = x["e"], x["kind"], x["head"], x["body"]
    at, end = F.instr(e, "@"), F.length(F.regexp_extract(e, r"\.[A-Za-z]{2,}$", 0))
    more = _more(list(_LOWER), digest, wider(attempt) * 4)  # for short names that all collide
    email = F.concat(_shaped(F.substring(e, F.lit(1), at - 1), digest, F.lit(False)), more, F.lit("@"), _shaped(F.substring(e, at + 1, F.length(e) - at - end), F.sha2(digest, 512), F.lit(False)), F.substring(e, F.length(e) - end + 1, end))
    ip = F.concat_ws(".", (_byte(digest, F.lit(1)) % 223 + 1).cast("string"), *[_byte(digest, F.lit(i)).cast("string") for i in (2, 3, 4)])
    hexes = body.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")
    longer = F.when(body.rlike("^[0-9]+$"), _more(list("0123456789"), digest, wider(attempt) * 4)).when(body.rlike("^[0-9a-f]+$"), _more(list("0123456789abcdef"), digest, wider(attempt) * 4))
    longer = longer.when(body.rlike("^[0-9A-Z]+$"), _more(list("0123456789ABCDEF"), digest, wider(attempt) * 4)).otherwise(more)
    plain = F.concat(head, _shaped(body, digest, hexes & (kind == "secret")), F.when(kind == "secret", longer).otherwise(F.lit("")))
    iban = F.concat(head, _spaced(_shaped(F.replace(body, F.lit(" "), F.lit("")), digest, F.lit(False)), body))
    first = F.element_at(F.split(body, " "), 1)
    given = F.concat(_given(first, woman, digest, attempt), _tail(digest, attempt))
    surname = lambda d, a: F.concat(_surname(last_of(x), d, a), _tail(d, a))
    person = F.concat(head, F.when(body.contains(" "), F.concat(given, F.lit(" "))).otherwise(F.lit("")), surname(surname_digest, surname_attempt))
    named = F.when(kind == "person", person).when(kind == "given", given).when(kind == "surname", surname(digest, attempt))
    return named.when(kind == "email", email).otherwise(F.concat(F.when(kind == "ip", ip).when(kind.isin("phone", "card", "ssn"), _numbers(e, kind, digest, attempt)).when(kind == "iban", iban).otherwise(plain), _tail(digest, attempt)))


def entities(text: Column) -> Column:
    return F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(ENTITY), 0)).otherwise(F.array().cast("array<string>"))


def later_attempts(parts: DataFrame, others: DataFrame, spark: SparkSession, key: str) -> DataFrame:
    """(kind, name, attempt) of the canonical entities that attempt 0 doesn't serve, from ``parts(x)``, and of the whole names ``others`` whose gender is told by titles."""
    forms = parts.select(F.col("x.kind").alias("kind"), F.col("x.name").alias("name"), "x").distinct()
    flips = others.select(F.lit("given").alias("kind"), "name", F.lit(OTHER).alias("flip"))
    forms = forms.join(flips, ["kind", "name"], "left").withColumn("flip", F.coalesce("flip", F.lit(0)))
    forms = materialize(forms.repartition(shuffle_width(spark), "kind", "name"), spark)
    known = forms.select("kind", F.col("name").alias("s")).distinct()
    waiting, taken, redone = forms, None, spark.createDataFrame([], "kind string, name string, attempt int")
    for attempt in range(ATTEMPTS):
        drawn = waiting.withColumn("s", surrogate(F.col("x"), lambda kind, name, n=attempt: F.lit(n) + F.col("flip"), key))
        # a given name must be distinct among those of its surname
        same = F.when(F.col("kind") == "surname", F.lower("s")).when(F.col("kind") == "given", F.concat(F.lower("s"), F.lit(" "), F.lower(last_of(F.col("x"))))).otherwise(F.element_at(described(F.array("s")), 1)["name"])
        drawn = materialize(drawn.select("kind", "name", "flip", same.alias("s")).distinct(), spark)
        first = drawn.groupBy("kind", "s").agg(F.min("name").alias("name"))
        free = drawn.join(first, ["kind", "s", "name"]).join(known, ["kind", "s"], "left_anti")
        if taken is not None:
            free = free.join(taken, ["kind", "s"], "left_anti")
        # a name is served when the surrogates of all its written forms are free
        lost = materialize(drawn.join(free, ["kind", "s", "name"], "left_anti").select("kind", "name").distinct(), spark)
        good = materialize(drawn.join(lost, ["kind", "name"], "left_anti").select("kind", "s", "name", "flip"), spark)
        taken = good.select("kind", "s") if taken is None else taken.union(good.select("kind", "s"))
        redone = redone.union(good.where(F.lit(attempt) + F.col("flip") > 0).select("kind", "name", (F.lit(attempt) + F.col("flip")).alias("attempt")).distinct())
        waiting = materialize(waiting.join(lost, ["kind", "name"], "left_semi").select("kind", "name", "flip", "x"), spark)
        if waiting.isEmpty():
            return redone
    return redone.union(waiting.select("kind", "name", (F.lit(ATTEMPTS) + F.col("flip")).alias("attempt")).distinct())


def with_givens(found: Column, new: Column) -> Column:
    """``new`` with a person known by one word named as the whole name in the same text whose first name that is."""
    pairs = F.arrays_zip(found.alias("x"), new.alias("s"))
    whole = F.filter(pairs, lambda y: (y["x"]["kind"] == "person") & y["x"]["body"].contains(" "))

    def one(y: Column) -> Column:
        x = y["x"]
        owner = F.get(F.filter(whole, lambda w: first_of(w["x"]["body"]) == x["body"]), F.lit(0))
        given = first_of(F.substring(owner["s"], F.length(owner["x"]["head"]) + 1, F.length(owner["s"])))
        return F.when((x["kind"] == "person") & ~x["body"].contains(" ") & owner.isNotNull(), F.concat(x["head"], given)).otherwise(y["s"])

    return F.when(F.size(whole) > 0, F.transform(pairs, one)).otherwise(new)


def alone(text: Column, found: Column, new: Column, plain: Column) -> Column:
    """``text`` with the names of the persons in ``found`` replaced where they stand without title: whole names, then surnames, then given names.

    A word that ``plain``, the text as it was, also has in lower case or before or after a number is a word of the language as well, so it stays
    where it stands alone.
    """
    people = F.filter(F.arrays_zip(found.alias("x"), new.alias("s")), lambda y: y["x"]["kind"] == "person")
    names = F.transform(people, lambda y: F.struct(y["x"]["body"].alias("old"), F.substring(y["s"], F.length(y["x"]["head"]) + 1, F.length(y["s"])).alias("new")))
    part = lambda p, at: F.struct(F.element_at(F.split(p["old"], " "), at).alias("old"), F.element_at(F.split(p["new"], " "), at).alias("new"))
    whole = F.filter(names, lambda p: p["old"].contains(" "))
    all_names = F.array_distinct(F.concat(whole, F.transform(names, lambda p: part(p, -1)), F.transform(whole, lambda p: part(p, 1))))
    border = lambda x: F.concat(F.lit(r"(?<![\p{L}\p{M}])"), x, F.lit(r"(?![\p{L}\p{M}])"))
    exact = lambda x: F.concat(F.lit(r"\Q"), x, F.lit(r"\E"))
    common = lambda old: (plain.contains(F.lower(old)) & F.regexp_like(plain, border(exact(F.lower(old))))) | F.regexp_like(plain, F.concat(F.lit(r"[0-9][.,]?\s+"), exact(old), F.lit(r"(?![\p{L}\p{M}])|(?<![\p{L}\p{M}])"), exact(old), F.lit(r",?\s+[0-9]")))
    put = lambda t, p: F.when(t.contains(p["old"]), F.when(p["old"].contains(" ") | ~common(p["old"]), F.regexp_replace(t, border(exact(p["old"])), p["new"])).otherwise(t)).otherwise(t)
    return F.aggregate(all_names, text, put)


def replace_pii(docs: DataFrame, spark: SparkSession, key: str = "quillon") -> DataFrame:
    """One row per row of ``docs``: doc_id, text with surrogates, n_entities, kinds (sorted, distinct).

    Null text stays null, with 0 entities; texts without an entity stay as they are. The result hangs
    on ``key`` and on the set of entities, not on order or partitioning; equal texts get equal results, repeated
    rows stay, null ids stay null. An empty table gives an empty result; other columns are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.withColumn("found", F.coalesce(entities(F.col("text")), F.array().cast("array<string>")))
    # a text is looked through once: what stands between its entities is written in its place
    between = F.when(F.size("found") > 0, F.split("text", ENTITY, -1))
    docs = materialize(docs.select("doc_id", F.when(F.size("found") == 0, F.col("text")).alias("text"), between.alias("between"), F.xxhash64("text").alias("h"), described(F.col("found")).alias("found")), spark)
    seen = docs.where(F.size("found") > 0).select("doc_id", "h", F.explode("found").alias("x")).select("doc_id", "h", F.explode(parts_of(F.col("x"))).alias("x"))
    people = docs.where(F.size("found") > 0).select(F.explode("found").alias("x"))
    redone = materialize(later_attempts(seen.select("x"), materialize(told_otherwise(people), spark), spark, key), spark)
    special = seen.alias("a").join(redone.alias("b"), (F.col("a.x.kind") == F.col("b.kind")) & (F.col("a.x.name") == F.col("b.name")))
    special = special.select("doc_id", "h", F.concat_ws("\x1f", "b.kind", "b.name").alias("part"), "attempt").distinct()
    special = special.groupBy("doc_id", "h").agg(F.map_from_entries(F.collect_list(F.struct("part", "attempt"))).alias("later"))  # as long as one text
    special = materialize(special.select(F.col("doc_id").alias("_id"), F.col("h").alias("_h"), "later"), spark)
    rows = docs.join(special, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h")), "left")
    attempt = lambda kind, name: F.coalesce(F.try_element_at(F.col("later"), F.concat_ws("\x1f", kind, name)), F.lit(0))
    rows = rows.withColumn("new", F.transform("found", lambda x: surrogate(x, attempt, key)))
    rows = rows.withColumn("new", with_givens(F.col("found"), F.col("new")))
    joined = F.array_join(F.flatten(F.zip_with("between", "new", lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))), "")
    people = F.exists("found", lambda x: x["kind"] == "person")
    return rows.withColumn("text", F.when(F.size("found") > 0, joined).otherwise(F.col("text"))).select(
        "doc_id",
        F.when(people, alone(F.col("text"), F.col("found"), F.col("new"), F.array_join("between", "\n"))).otherwise(F.col("text")).alias("text"),
        F.size("found").cast("long").alias("n_entities"),
        F.when(F.col("h").isNotNull(), F.array_sort(F.array_distinct(F.transform("found", lambda x: x["kind"])))).alias("kinds"),
    )


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace_pii(table(spark, sf_dir, "documents"), spark)
