"""Text functions as column expressions: all of them run inside the JVM."""

from __future__ import annotations

import functools
import json
import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a token is, after compatibility decomposition and lower-casing.
TOKEN = r"[a-z0-9]+(?:\.[0-9]+)?"


@functools.cache
def _folding() -> tuple[str, str, str, dict[str, str]]:
    """Characters beyond ASCII whose decomposition matters to tokens, from the Unicode tables.

    Returns the ones that leave one ASCII character followed by marks (which end a token), all with
    one ASCII character, those characters, and the rest with what they become.
    """
    broken, single, base, several = [], [], [], {}
    for point in range(0x80, 0x110000):
        c = chr(point)
        if unicodedata.category(c) in ("Cn", "Cs", "Co"):
            continue
        flat = unicodedata.normalize("NFKD", c).lower()
        if flat == c or not re.search(r"[a-z0-9.]", flat):
            continue
        if re.fullmatch(r"[a-z0-9.]", flat):
            single.append(c)
            base.append(flat)
        elif re.fullmatch(r"[a-z0-9.][^\x00-\x7f]+", flat):
            broken.append(c)
            single.append(c)
            base.append(flat[0])
        else:
            several[c] = re.sub(r"[^a-z0-9.]", " ", flat)
    return "".join(broken), "".join(single), "".join(base), several


def folded(x: Column) -> Column:
    """``x`` lower-cased, with letters and digits decomposed to ASCII; marks have become breaks. Null is empty."""
    broken, single, base, several = _folding()
    x = F.coalesce(x.cast("string"), F.lit(""))
    near = [c for c in single if c <= "\u00ff"]  # most texts hold no other: a small class is a bit table
    plain = F.translate(F.regexp_replace(x, f"([{''.join(c for c in broken if c <= '\u00ff')}])", "$1 "), "".join(near), "".join(base[single.index(c)] for c in near))
    table = F.from_json(F.lit(json.dumps(several)), "map<string,string>")  # folded to one constant
    chars = F.transform(F.sequence(F.lit(1), F.length(x)), lambda i: F.substring(x, i, F.lit(1)))
    spelled = F.array_join(F.transform(chars, lambda c: F.coalesce(F.try_element_at(table, c), c)), "")
    spelled = F.when(x.rlike(f"[{''.join(several)}]"), spelled).otherwise(x)
    full = F.translate(F.regexp_replace(spelled, f"([{broken}])", "$1 "), single, base)
    return F.lower(F.when(x.rlike(f"[^\\x00-\\xff]|[{''.join(c for c in several if c <= '\u00ff')}]"), full).otherwise(plain))


def tokens(x: Column) -> Column:
    """Tokens in order; an empty array for null and for text without any."""
    return F.regexp_extract_all(folded(x), F.lit(TOKEN), 0)


def normalized(x: Column) -> Column:
    return F.array_join(tokens(x), " ")


def holds(gold_norm: Column, context_norm: Column) -> Column:
    """Exact containment of normalized texts: not bound to token borders, false for an empty gold."""
    return (gold_norm != "") & F.contains(context_norm, gold_norm)


def relaxed_holds(gold: Column, evidence: Column, max_missing: int = 1) -> Column:
    """Whether at most ``max_missing`` of the bigrams of ``gold`` (token arrays, counted as a multiset) lack in ``evidence``.

    No gold token: false. One: membership. With two tokens one bigram may lack, so always true.
    """
    grams = lambda t: F.transform(F.sequence(F.lit(1), F.size(t) - 1), lambda i: F.concat_ws(" ", F.get(t, i - 1), F.get(t, i)))
    none = F.array().cast("array<string>")
    g, e = F.when(F.size(gold) > 1, grams(gold)).otherwise(none), F.when(F.size(evidence) > 1, grams(evidence)).otherwise(none)
    count = lambda a, v: F.size(F.filter(a, lambda y: y == v))
    missing = F.aggregate(F.array_distinct(g), F.lit(0), lambda acc, v: acc + F.greatest(count(g, v) - count(e, v), F.lit(0)))
    return F.when(F.size(gold) == 0, False).when(F.size(gold) == 1, F.array_contains(evidence, F.get(gold, F.lit(0)))).otherwise(missing <= max_missing)


def stripped(x: Column) -> Column:
    """Without white space, any of Unicode, at both ends."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def is_blank(x: Column) -> Column:
    return stripped(F.coalesce(x, F.lit(""))) == ""


def cleaned(x: Column) -> Column:
    """Null, and texts that spell a missing number, as empty."""
    return F.when(x.isNull() | (F.lower(x) == "nan"), F.lit("")).otherwise(x)


def column_slug(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(x), r"[^a-z0-9]+", "_"), r"^_+|_+$", "")


def file_slug(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(x, r"[^a-zA-Z0-9._-]+", "-"), r"^-+|-+$", "")


def sha256(x: Column) -> Column:
    return F.sha2(F.coalesce(x, F.lit("")), 256)


def json_object(x: Column) -> Column:
    """From the first brace to the last, over code fences and prose; null if there is none."""
    return F.nullif(F.regexp_extract(x, r"(?s)\{.*\}", 0), F.lit(""))


#: Fixed value: what may follow a label, as the inside of a character class.
LABEL_ENDS = r"""\s:.,;!?)\]}'"\-—"""


def leading_label(x: Column, labels: tuple[str, ...]) -> Column:
    """The label that opens ``x`` in any case, followed by its end or one of LABEL_ENDS; null otherwise."""
    found = F.regexp_extract(x, rf"(?iU)^\s*({'|'.join(labels)})(?=$|[{LABEL_ENDS}])", 1)
    return F.initcap(F.nullif(found, F.lit("")))


def excerpts(x: Column) -> Column:
    """Parts between lines that hold an ellipsis alone."""
    return F.split(x, r"\n\s*\.\.\.\s*\n", -1)


def last_segment(url: Column) -> Column:
    return F.substring_index(F.regexp_replace(url, "/+$", ""), "/", -1)


def trailing_ordinal(query_id: Column) -> Column:
    return F.regexp_extract(query_id, r"(\d+)$", 1).try_cast("bigint")


def json_list(values: Column, ascii_only: bool = False) -> Column:
    """An array of texts as a JSON list with a space behind each comma; ``ascii_only`` writes other characters as UTF-16 escapes."""
    quoted = lambda x: F.regexp_replace(F.to_json(F.array(x)), r"(?s)^\[(.*)\]$", "$1")
    units = lambda c: F.regexp_replace(F.lower(F.hex(F.encode(c, "UTF-16BE"))), "(.{4})", r"\\u$1")
    escaped = lambda x: F.array_join(F.transform(F.split(x, ""), lambda c: F.when(c.rlike(r"^[\x00-\x7f]*$"), c).otherwise(units(c))), "")
    each = F.transform(values, lambda x: escaped(quoted(x)) if ascii_only else quoted(x))
    return F.concat(F.lit("["), F.array_join(each, ", "), F.lit("]"))


def padded_id(name: Column, ordinal: Column) -> Column:
    return F.format_string("%s-%06d", name, ordinal)


def compound_id(*parts: Column, keep_missing: bool = False) -> Column:
    """Ids joined by a bar; a missing component is an empty segment or is left out."""
    return F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) if keep_missing else p.cast("string") for p in parts])


def as_number(x: Column) -> Column:
    """A double, null where it is none or not a number."""
    n = x.try_cast("double")
    return F.when(~F.isnan(n), n)


def effort(x: Column) -> Column:
    return F.when(x == "none", "not_requested").otherwise(x)


def total_tokens(*columns: Column) -> Column:
    """The first usage figure that is there, else 0."""
    return F.coalesce(*columns, F.lit(0)).cast("long")
