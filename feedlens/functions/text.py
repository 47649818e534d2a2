"""Text, date and number functions as Column builders (no Python at run time)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedlens.constants import LEVELS, NOT_WORD, NOT_WS, PUNCTUATION, SEVERITY_KEYWORDS, WS, WS_CHARS

DATE_FORMATS = [
    "yyyy/MM/dd", "MM/dd/yyyy", "MM dd, yyyy", "MM d, yyyy", "MMM d, yyyy", "d MMM yyyy",
    "MM/dd/yyyy HH:mm:ss", "yyyy/MM/dd HH:mm:ss",
]


def let(value: Column, body) -> Column:
    """Bind ``value`` once and use it many times inside ``body`` (a one-element transform)."""
    return F.transform(F.array(value), body)[0]


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WS_CHARS))


def is_blank(c: Column) -> Column:
    return c.isNull() | ~c.rlike(NOT_WS)


def match_key(c: Column) -> Column:
    """Exact-match key of one text: lower case, no ASCII punctuation, single spaces."""
    bare = F.translate(F.lower(F.coalesce(c, F.lit(""))), PUNCTUATION, "")
    return strip(F.regexp_replace(bare, f"{WS}+", " "))


def ticket_key(topic: Column, message: Column) -> Column:
    return F.concat_ws("||", match_key(topic), match_key(message))


def embedding_text(topic: Column, message: Column) -> Column:
    blank = F.lit("")
    return F.format_string("Topic: %s | Message: %s", F.coalesce(topic, blank), F.coalesce(message, blank))


def first_words(message: Column, n: int = 4) -> Column:
    words = F.split(strip(message), f"{WS}+")
    return F.array_join(F.slice(words, 1, n), " ")


def query_text(keywords: Column) -> Column:
    """One query string from a list of keywords; blanks are dropped. Null when nothing is left."""
    kept = F.filter(F.transform(keywords, strip), lambda k: F.length(k) > 0)
    return F.nullif(F.array_join(kept, " "), F.lit(""))


def require_text(c: Column, what: str) -> Column:
    """The stripped text, or a run-time error where it is blank."""
    return F.when(is_blank(c), F.raise_error(F.lit(f"{what} must be a non-empty string"))).otherwise(strip(c))


def is_severe(message: Column) -> Column:
    """True where the lower-cased message contains one of the severity words as a substring."""
    words = "|".join(rf"\Q{w}\E" for w in SEVERITY_KEYWORDS)
    return F.coalesce(F.lower(message).rlike(words), F.lit(False))


def parse_time(c: Column) -> Column:
    """Timestamp of a free-form date text, null where nothing parses."""
    text = strip(c.cast("string"))
    tries = [text.try_cast("timestamp")]
    tries += [F.try_to_timestamp(text, F.lit(f)) for f in DATE_FORMATS]
    seconds = F.when(text.rlike("^[0-9]{9,10}$"), F.timestamp_seconds(text.try_cast("bigint")))
    return F.coalesce(seconds, *tries)


def words(text: Column) -> Column:
    """Lower-cased runs of letters, digits and underscore, of any script."""
    return F.array_remove(F.split(F.lower(text), NOT_WORD), "")


def _set_overlap(a: Column, b: Column) -> Column:
    def ratio(pair):
        both = F.size(F.array_intersect(pair["a"], pair["b"]))
        total = F.size(pair["a"]) + F.size(pair["b"]) - both
        return F.when(total == 0, F.lit(1.0)).otherwise(both / total)

    sets = F.struct(F.array_distinct(a).alias("a"), F.array_distinct(b).alias("b"))
    return let(sets, ratio)


def token_jaccard(a: Column, b: Column) -> Column:
    return _set_overlap(words(a), words(b))


def char_ngrams(text: Column, n: int = 3) -> Column:
    """All character n-grams of a text, in one linear pass of overlapping look-aheads."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1))


def ngram_clean(text: Column) -> Column:
    return F.regexp_replace(strip(F.lower(text)), f"{WS}+", " ")


def ngram_jaccard(a: Column, b: Column, n: int = 3) -> Column:
    """3-gram Jaccard; texts shorter than ``n`` are compared for equality."""

    def score(pair):
        a, b = pair["a"], pair["b"]
        short = (F.length(a) < n) | (F.length(b) < n)
        same = F.when(a == b, F.lit(1.0)).otherwise(F.lit(0.0))
        return F.when(short, same).otherwise(_set_overlap(char_ngrams(a, n), char_ngrams(b, n)))

    return let(F.struct(ngram_clean(a).alias("a"), ngram_clean(b).alias("b")), score)


def same_topic(a: Column, b: Column) -> Column:
    return F.coalesce(F.lower(strip(a)), F.lit("")) == F.coalesce(F.lower(strip(b)), F.lit(""))


def level(c: Column, default: float) -> Column:
    """A criterion given as label or number on the scale 1..5; unreadable values get the default."""
    text = F.lower(strip(c.cast("string")))
    named = F.create_map(*[F.lit(x) for kv in LEVELS.items() for x in kv])
    number = text.try_cast("double")
    # least and greatest skip nulls, so an unreadable number must not reach them
    number = F.when(number.isNotNull() & ~F.isnan(number), clip(number, 1.0, 5.0))
    return F.coalesce(F.try_element_at(named, text), number, F.lit(default))


def rescale(lvl: Column) -> Column:
    return (lvl - 1.0) / 4.0 * 100.0


def shorten(text: Column, limit: int) -> Column:
    text = F.coalesce(text, F.lit(""))
    return F.concat(F.substring(text, 1, limit), F.when(F.length(text) > limit, "...").otherwise(""))


def clip(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def row_fingerprint(topic: Column, message: Column) -> Column:
    return F.md5(F.concat(F.coalesce(topic, F.lit("")), F.lit("||"), F.coalesce(message, F.lit(""))))


def round_half_even(c: Column, digits: int) -> Column:
    """Round the exact binary value of a double, ties to even.

    ``bround`` rounds the shortest decimal text of a double, so 2.675 (in fact 2.67499...) goes
    up. Here the distance to the tie is computed without error: the factor is small enough
    that its products with both halves of the split number are exact.
    """
    x, scale = c.cast("double"), float(10**digits)
    wide = x * 134217729.0  # 2^27 + 1 splits the 53 bits in two halves
    high = wide - (wide - x)
    low = x - high
    down = F.floor(x * scale)
    over = (high * (2.0 * scale) - (down * 2 + 1)) + low * (2.0 * scale)
    up = (over > 0) | ((over == 0) & (F.abs(down) % 2 == 1))
    return F.when(up, down + 1).otherwise(down) / scale


def fixed(c: Column, digits: int) -> Column:
    """Number with a fixed count of decimals, half to even."""
    return F.format_string(f"%.{digits}f", round_half_even(c, digits))


def bullets(items: Column, empty: str = "None identified.") -> Column:
    lines = F.array_join(F.transform(items, lambda x: F.concat(F.lit("- "), x)), "\n")
    return F.when(F.coalesce(F.size(items), F.lit(0)) <= 0, F.lit(f"- {empty}")).otherwise(lines)


def fill(template: str, **values: Column) -> Column:
    """``template`` with each ``{name}`` replaced by a column; other text stays as it is."""
    pieces, rest = [], template
    while rest:
        spots = [(rest.find("{" + n + "}"), n) for n in values if "{" + n + "}" in rest]
        if not spots:
            pieces.append(F.lit(rest))
            break
        at, name = min(spots)
        if at:
            pieces.append(F.lit(rest[:at]))
        pieces.append(values[name].cast("string"))
        rest = rest[at + len(name) + 2 :]
    return F.concat(*pieces) if pieces else F.lit("")
