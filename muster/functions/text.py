"""Column functions over text, JVM-side throughout."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from muster.functions.fixed import LEGAL_FORMS

#: White space as Python sees it; plain \\s is ASCII only in Java.
SPACE = r"(?U)\s+"


def let(value: Column, body) -> Column:
    """body(value) with value worked out once, also where body uses it inside a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def collapse(c: Column) -> Column:
    return strip(F.regexp_replace(c, SPACE, " "))


def clean_html(c: Column) -> Column:
    """Entities unescaped (the five core ones, the apostrophe and the non-breaking space), tags to blanks, blanks collapsed."""
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(char))
    return collapse(F.regexp_replace(c, r"<[^>]+>", " "))


def tokens(c: Column) -> Column:
    return F.filter(F.split(F.lower(strip(c)), SPACE), lambda w: w != "")


def shingles(c: Column, k: int = 5) -> Column:
    """The set of runs of k words; a shorter text is one shingle, an empty one none."""

    def runs(w: Column) -> Column:
        each = F.transform(F.sequence(F.lit(1), F.size(w) - (k - 1)), lambda i: F.array_join(F.slice(w, i, k), " "))
        return F.when(F.size(w) >= k, F.array_distinct(each)).when(F.size(w) > 0, F.array(F.array_join(w, " "))).otherwise(F.array().cast("array<string>"))

    return let(tokens(c), runs)


def exact_key(c: Column) -> Column:
    return F.lower(strip(c))


def normal_org(c: Column) -> Column:
    c = F.regexp_replace(F.lower(c), rf"\b({'|'.join(LEGAL_FORMS)})\b", "")
    c = F.regexp_replace(c, r"[^a-z0-9\s]", " ")
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def normal_state(c: Column) -> Column:
    return F.nullif(F.upper(strip(F.coalesce(c, F.lit("")))), F.lit(""))


def location_key(city: Column, state: Column) -> Column:
    city, state = strip(F.coalesce(city, F.lit(""))), normal_state(state)
    return F.when(state.isNull(), None).when(city == "", state).otherwise(F.concat(city, F.lit(", "), state))


def token_estimate(c: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(F.substring(c, 1, 4000)) / 4).cast("int"))


def premise_hash(premises: Column) -> Column:
    plain = F.array_sort(F.transform(premises, lambda p: F.lower(strip(p))))
    return F.substring(F.md5(F.array_join(plain, "||")), 1, 16)


def words(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(r"\p{L}+"), F.lit(0))


def sentences(c: Column) -> Column:
    return F.filter(F.split(c, r"[.!?]+[\s ]+"), lambda s: strip(s) != "")


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets; 0 when either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / F.size(F.array_union(a, b)))


def either_contains(a: Column, b: Column) -> Column:
    return F.contains(a, b) | F.contains(b, a)


def compact_number(c: Column) -> Column:
    return F.when(c >= 1e6, F.concat(F.format_string("%.1f", c / 1e6), F.lit("M"))).when(c >= 1e3, F.concat(F.format_string("%.1f", c / 1e3), F.lit("K"))).otherwise(c.cast("long").cast("string"))


def dollars(c: Column) -> Column:
    """'$ n', 'n K' or 'n M' as a number of dollars; null where there is no number."""
    n = F.regexp_extract(F.replace(c, F.lit(",")), r"([0-9]+(?:\.[0-9]+)?)", 1)
    unit = F.upper(F.regexp_extract(F.replace(c, F.lit(",")), r"[0-9]\s*([KMkm])", 1))
    return F.nullif(n, F.lit("")).cast("double") * F.when(unit == "M", 1e6).when(unit == "K", 1e3).otherwise(1.0)


def acronym(c: Column) -> Column:
    """Initials of the words of three letters or more but for small ones, six at most."""
    w = F.filter(F.split(F.lower(c), r"[^a-z]+"), lambda x: (F.length(x) >= 3) & ~x.isin("of", "the", "and", "for"))
    return F.upper(F.array_join(F.slice(F.transform(w, lambda x: F.substring(x, 1, 1)), 1, 6), ""))


def unit(v: Column) -> Column:
    norm = F.sqrt(F.aggregate(v.cast("array<double>"), F.lit(0.0), lambda a, x: a + x * x)) + 1e-12
    return let(norm, lambda n: F.transform(v.cast("array<double>"), lambda x: x / n))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def entropy(counts: Column) -> Column:
    """Shannon entropy in bits of an array of counts; 0 when empty."""
    total = F.aggregate(counts.cast("array<double>"), F.lit(0.0), lambda a, x: a + x)
    bits = lambda t: F.aggregate(counts.cast("array<double>"), F.lit(0.0), lambda a, x: F.when(x > 0, a - (x / t) * F.log2(x / t)).otherwise(a))
    return let(total, lambda t: F.when(t > 0, bits(t)).otherwise(0.0))


def finite(c: Column) -> Column:
    v = c.cast("double")
    return F.when(F.isnan(v) | (F.abs(v) == F.lit(float("inf"))), None).otherwise(v)


def finite_or_large(c: Column) -> Column:
    """c with NaN as null; infinite values stay."""
    v = c.cast("double")
    return F.when(F.isnan(v), None).otherwise(v)
