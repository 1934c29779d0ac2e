"""Column expressions for cleaning names, lists and texts. All are built-in expressions: no Python runs per row.

NULL means missing; every function here takes NULL as the empty string and returns a string unless it says otherwise.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as C

#: What Python's str.strip() takes off: fixed values.
BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def text(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def sub(c: Column, pattern: str, to: str = " ") -> Column:
    return F.regexp_replace(c, pattern, to)


def strip(c: Column) -> Column:
    """Python's str.strip(): all white space, where trim() takes spaces only. Looks at the ends alone, not at every run of blanks."""
    return F.btrim(c, F.lit(BLANKS))


def squeeze(c: Column) -> Column:
    return strip(sub(c, r"(?U)\s+"))


def replace_all(c: Column, pairs: list[tuple[str, str]]) -> Column:
    return reduce(lambda e, p: F.replace(e, F.lit(p[0]), F.lit(p[1])), pairs, c)


def is_blank(c: Column | str) -> Column:
    return strip(text(c)) == ""


# names ------------------------------------------------------------------------------------------


def strip_dosage_and_form(c: Column | str) -> Column:
    return squeeze(sub(text(c), "(?iu)" + C.DOSAGE))


def normalize_text(c: Column | str) -> Column:
    base = F.replace(strip(F.lower(text(c))), F.lit("_"), F.lit(" "))
    return strip_dosage_and_form(squeeze(sub(base, C.NAME_CHARS)))


def clean_generic(c: Column | str) -> Column:
    base = strip(F.lower(text(c)))
    base = reduce(lambda e, p: sub(e, p, ""), C.NAME_PREFIXES, base)
    return sub(squeeze(sub(base, C.GENERIC_CHARS)), "^0xygen", "oxygen")


def short_brand_key(c: Column | str, words: int = 3) -> Column:
    return F.array_join(F.slice(F.split(normalize_text(c), " "), 1, words), " ")


def norm_term(c: Column | str) -> Column:
    return F.lower(squeeze(text(c)))


def simple_term(c: Column | str) -> Column:
    return F.lower(strip(text(c)))


def dupe_key(c: Column | str) -> Column:
    """Lower case, one space between words, then all but letters, digits and spaces deleted; edges stay as they fall."""
    return sub(squeeze(F.lower(text(c))), r"[^a-z0-9 ]", "")


# texts ------------------------------------------------------------------------------------------


def fix_mojibake(c: Column | str) -> Column:
    return F.when(is_blank(c), "").otherwise(squeeze(replace_all(text(c), C.MOJIBAKE)))


def fix_truncations(c: Column | str) -> Column:
    base = F.replace(text(c), F.lit("�"), F.lit(""))
    for name in C.CUT_NAMES:
        base = sub(base, f"(?iu){name}", C.WHOLE_NAME)
    base = sub(replace_all(base, C.TRUNCATIONS), C.CUT_ELLIPSIS, C.ELLIPSIS)
    return strip(sub(sub(sub(base, r"[ \t]+"), r"(?U)\s+\n", "\n"), r"(?U)\n\s+", "\n"))


def limit_text(c: Column | str, n: int) -> Column:
    return F.left(strip(text(c)), F.lit(n))


def hard_cap(c: Column | str, n: int) -> Column:
    """At most n characters, the last one an ellipsis if anything was cut."""
    base = strip(text(c))
    return F.when(F.length(base) <= n, base).otherwise(F.concat(F.rtrim(F.left(base, F.lit(n - 1)), F.lit(BLANKS)), F.lit("…")))


def soft_cap(c: Column | str, n: int = 1500) -> Column:
    base = text(c)
    return F.when(F.length(base) > n, F.concat(F.rtrim(F.left(base, F.lit(n)), F.lit(BLANKS)), F.lit("…"))).otherwise(base)


def canonical_breaks(c: Column | str) -> Column:
    """CR and CRLF to LF, the two characters \\n to a line break, runs of blanks to one, three breaks to two."""
    base = strip(sub(text(c), r"\r\n?", "\n"))
    return strip(sub(sub(F.replace(base, F.lit("\\n"), F.lit("\n")), r"[ \t]+"), r"\n{3,}", "\n\n"))


def display_text(c: Column | str, n: int = C.SHOWN_TEXT, least: int = C.SHOWN_LINE) -> Column:
    """For display: line breaks stay; lines of punctuation, labels told twice and lines under `least` characters go."""
    joined = lambda lines: strip(sub(F.array_join(lines, "\n"), r"\n{3,}", "\n\n"))
    lines = lambda t, f: joined(f(F.transform(F.split(t, "\n"), strip)))
    bare = lambda x: F.when(x == "", x).otherwise(strip(sub(x, "(?U)" + C.LEADING_PUNCTUATION, "")))
    out = lines(canonical_breaks(c), lambda a: F.transform(F.filter(a, lambda x: ~x.rlike("(?U)" + C.ONLY_PUNCTUATION)), bare))
    labels = sorted(C.LABELS, key=len, reverse=True)
    for again in (r"{0}\b[: ]*", r"{0}:\s*$"):  # below its label, a label that opens a line or is one
        for x in labels:
            out = sub(out, r"(?dmiU)^{0}:\s*\n\s*".format(x) + again.format(x), x + (":\n" if again.endswith("*") else ":"))
    out = lines(out, lambda a: F.transform(a, lambda x: strip(sub(x, r"[ \t]+"))))
    return soft_cap(lines(out, lambda a: F.filter(a, lambda x: (x == "") | (F.length(x) >= least) | x.endswith(":"))), n)


def sections(c: Column | str) -> Column:
    """(title, body) of each block between blank lines; a block without a title line has an empty title."""

    def parted(b: Column) -> Column:
        at = F.locate(":\n", b)
        titled = F.struct(strip(F.left(b, at - 1)).alias("title"), strip(F.substr(b, at + 2)).alias("body"))
        return F.when(at > 0, titled).otherwise(F.struct(F.lit("").alias("title"), b.alias("body")))

    blocks = F.filter(_parts(strip(text(c)), r"\n{2,}"), lambda b: b != "")
    return F.transform(blocks, parted)


def join_sections(a: Column) -> Column:
    """The text of which sections(text) would be a, its blocks stripped."""
    return F.array_join(F.transform(a, lambda x: F.when(x["title"] == "", x["body"]).otherwise(F.concat(x["title"], F.lit(":\n"), x["body"]))), "\n\n")


# lists in a cell --------------------------------------------------------------------------------


def distinct_keep_first(a: Column, key=F.lower, cap: int | None = None) -> Column:
    """The array kernel: first of each key, blanks dropped, in order, at most cap. With a cap the first keys are found by hashing and
    their items by place; without one, sorting by key and place keeps it n log n."""

    def firsts(s: Column) -> Column:
        new = F.filter(s, lambda x, i: (i == 0) | (F.get(s, i - 1)["k"] != x["k"]))
        return F.transform(F.array_sort(F.transform(new, lambda x: F.struct(x["i"], x["p"]))), lambda x: x["p"])

    if cap is not None:
        return first_of_each(a, key, lambda items, keys, distinct: items_of(items, keys, F.slice(distinct, 1, cap)))
    placed = F.transform(F.filter(a, lambda p: p != ""), lambda p, i: F.struct(key(p).alias("k"), i.alias("i"), p.alias("p")))
    return _let(F.array_sort(placed), firsts)


def first_of_each(a: Column, key, body) -> Column:
    """body(items without blanks, their keys, the distinct keys in order)."""
    keyed = lambda items: _let(F.transform(items, key), lambda keys: _let(F.array_distinct(keys), lambda distinct: body(items, keys, distinct)))
    return _let(F.array_remove(a, ""), keyed)


def items_of(items: Column, keys: Column, some: Column) -> Column:
    """The first item of each of some keys."""
    return F.transform(some, lambda k: F.get(items, (F.array_position(keys, k) - 1).cast("int")))


def _parts(c: Column, pattern: str, clean=strip) -> Column:
    return F.transform(F.split(c, pattern), clean)


def limit_csv_list(c: Column | str, cap: int) -> Column:
    return F.array_join(distinct_keep_first(_parts(text(c), ","), cap=cap), ", ")


def normalize_route(c: Column | str) -> Column:
    return F.array_join(distinct_keep_first(_parts(text(c), r"[,|/;]+", lambda p: _route(squeeze(p))), F.lower), ", ")


def _route(p: Column) -> Column:
    return F.when(F.lower(p).isin(C.ROUTE_CODES), F.upper(p)).otherwise(F.initcap(p))


def title_case(c: Column) -> Column:
    """Python's str.title(): a letter after any non-letter is upper case. Letters are split off one by one."""
    chars = F.split(F.lower(c), "")
    # Spark's split by the empty string yields one character each
    return F.array_join(F.transform(chars, lambda x, i: F.when((i == 0) | ~F.get(chars, i - 1).rlike(r"\p{L}"), F.upper(x)).otherwise(x)), "")


def normalize_route_service(c: Column | str) -> Column:
    up = lambda p: F.when(F.lower(p).isin(C.ROUTE_CODES), F.upper(p)).otherwise(title_case(p))
    return F.array_join(distinct_keep_first(_parts(text(c), r"[,|/;]+", lambda p: up(strip(p)))), ", ")


def trim_brand_names(c: Column | str, cap: int = C.MAX_BRANDS) -> Column:
    def told(items: Column, keys: Column, distinct: Column) -> Column:
        joined, n = F.array_join(items_of(items, keys, F.slice(distinct, 1, cap)), ", "), F.size(distinct)
        return F.when(n > cap, F.concat(joined, F.lit(", ... (+"), (n - cap).cast("string"), F.lit(" more)"))).otherwise(joined)

    base = sub(F.replace(F.replace(text(c), F.lit("|"), F.lit(",")), F.lit(";"), F.lit(",")), r"(?U)\s+")
    return first_of_each(_parts(base, ","), F.lower, told)


def clean_side_effects_text(c: Column | str, cap: int = 120) -> Column:
    base = squeeze(F.replace(fix_truncations(c), F.lit("|"), F.lit(",")))
    return F.array_join(_effects(base, cap), ", ")


def clean_list(c: Column | str, cap: int = 80) -> Column:
    base = squeeze(F.replace(text(c), F.lit("|"), F.lit(",")))
    return _let(base, lambda t: F.coalesce(F.nullif(F.array_join(_effects(t, cap), ", "), F.lit("")), t))


def _effects(c: Column, cap: int) -> Column:
    return distinct_keep_first(_parts(c, ",", lambda p: F.btrim(p, F.lit(" .;"))), cap=cap)


def side_effect_map(columns: dict[str, Column]) -> Column:
    """Map of bucket to list, without blank buckets; NULL if none is left."""
    pairs = [x for k, c in columns.items() for x in (F.lit(k), clean_list(c))]
    found = F.map_filter(F.create_map(*pairs), lambda k, v: v != "")
    return F.when(F.size(found) > 0, found)


def dedupe_path(a: Column) -> Column:
    return first_of_each(a, normalize_text, lambda items, keys, distinct: items_of(items, keys, F.array_remove(distinct, "")))


# values -----------------------------------------------------------------------------------------


def frequency_bucket(c: Column | str) -> Column:
    f = norm_term(c)
    share = F.when(f.endswith("%"), _number(F.rtrim(f, F.lit("%"))))
    return (
        reduce(lambda e, kv: e.when(f.isin(kv[1]), kv[0]), list(C.FREQUENCY_WORDS.items()), F.when(F.lit(False), ""))
        .when(share >= 1, "common")
        .when(share >= 0.1, "less_common")
        .when(share.isNotNull(), "rare")
        .otherwise("unknown")
    )


def _number(c: Column) -> Column:
    return c.try_cast("double")


def lenient_int(c: Column | str) -> Column:
    """Whole part of a number as a 64-bit integer; 0 where there is none: text, NULL, NaN, infinities and what is out of range."""
    return F.coalesce(F.nanvl((F.col(c) if isinstance(c, str) else c).try_cast("double"), F.lit(0.0)).try_cast("bigint"), F.lit(0).cast("bigint"))


def priority(c: Column | str, table: dict[str, int], other: int = 99) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[F.col(c) if isinstance(c, str) else c], F.lit(other))


def score_to_confidence(c: Column | str) -> Column:
    s = F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(0.0))
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), s)) / 100, 4)


def classify_status(confidence: Column, has_best: Column) -> Column:
    return F.when(has_best & (confidence >= C.OK_THRESHOLD), "ok").when(has_best & (confidence >= C.LOW_THRESHOLD), "low_confidence").otherwise("no_match")


def percent(n: Column, total: Column) -> Column:
    return F.when(total > 0, n / total * 100).otherwise(0.0)


# predicates -------------------------------------------------------------------------------------


def looks_bad_generic(c: Column | str) -> Column:
    return is_blank(c) | F.lower(text(c)).rlike(C.BAD_GENERIC)


def route_ok(c: Column | str) -> Column:
    return F.arrays_overlap(_parts(F.upper(text(c)), ","), F.array(*[F.lit(r) for r in C.ROUTES]))


def is_single_name(c: Column | str) -> Column:
    s = strip(F.lower(text(c)))
    return (s != "") & (F.length(s) <= C.MAX_LEN) & ~s.rlike(C.MIXTURE) & (F.size(F.split(squeeze(s), " ")) <= C.MAX_WORDS) & (F.regexp_count(s, F.lit(r"\d")) < 3) & ~s.startswith("above ")


def contains_any(c: Column | str, words: list[str]) -> Column:
    """Any of the words as a substring, not as a whole word."""
    s = F.lower(text(c))
    return reduce(lambda a, b: a | b, [s.contains(w) for w in words])


def bad_encoding(c: Column | str) -> Column:
    return text(c).rlike("(?iu)" + C.BAD_ENCODING)


def too_long(c: Column | str, n: int = C.LONG_TEXT) -> Column:
    return F.length(text(c)) > n


def _let(value: Column, body) -> Column:
    """body(value), with value computed once per row instead of once per element of the lambdas in body."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeated_window(c: Column | str, n: int = C.WINDOW_WORDS) -> Column:
    """Whether a window of n words occurs twice; the last window of the text is not looked at."""

    def test(w: Column) -> Column:
        places = F.sequence(F.lit(0), F.greatest(F.size(w) - (n + 1), F.lit(0)))
        windows = F.transform(places, lambda i: F.xxhash64(F.array_join(F.slice(w, i + 1, n), " ")))
        return (F.size(w) >= 2 * n) & (F.size(F.array_distinct(windows)) < F.size(w) - n)

    return _let(F.regexp_extract_all(F.lower(text(c)), F.lit("([a-z0-9]+)")), test)


def label_repeats(c: Column | str, labels: list[str] = C.LABELS) -> Column:
    s = F.lower(text(c))
    times = [(F.length(s) - F.length(F.replace(s, F.lit(x), F.lit("")))) / len(x) for x in (f"{v.lower()}:" for v in labels)]
    return reduce(lambda a, b: a | b, [t > 1 for t in times])
