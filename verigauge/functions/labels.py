"""Label, verdict and text column expressions."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from verigauge.functions.numeric import nan_to_null

# The words and names that existing data sets use.
REAL_TOKENS = ("real", "authentic", "natural", "human", "nature", "camera", "genuine", "0")
AI_TOKENS = ("ai", "aigc", "fake", "generated", "synthetic", "gen", "sd", "midjourney", "1")
YES_WORDS = ("1", "true", "yes")
NO_WORDS = ("0", "false", "no")
FILENAME_REGEX = r"^(real|authentic|ai|aigc|fake|generated)[_\-.]"
GENERATOR_ALIASES = {
    "sd3": "SD3", "stablediffusion3": "SD3", "sd21": "SD2_1", "stablediffusion21": "SD2_1",
    "sdxl": "SDXL", "dalle3": "DALLE3", "midjourney6": "MidJourney6",
    "midjourneyv6": "MidJourney6",
}
URL_COLUMNS = ("photo_image_url", "photo_url", "urls_regular", "url")
TEXT_COLUMN_WORDS = ("description", "keyword", "tag", "alt")
MIN_PAYLOAD = 5000


def token_label(token: Column, real: Sequence[str] = REAL_TOKENS,
                ai: Sequence[str] = AI_TOKENS) -> Column:
    """0 for a word of the real set, 1 for one of the AI set, else NULL."""
    word = F.lower(F.trim(token))
    return F.when(word.isin(*real), 0).when(word.isin(*ai), 1)


def directory_label(rel_path: Column, real: Sequence[str] = REAL_TOKENS,
                    ai: Sequence[str] = AI_TOKENS) -> Column:
    """Label of the deepest directory that carries one; the file name does not count."""
    parts = F.split(rel_path, "/")
    folders = F.reverse(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))))
    found = F.filter(F.transform(folders, lambda p: token_label(p, real, ai)),
                     lambda v: v.isNotNull())
    return F.try_element_at(found, F.lit(1))


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def filename_label(name: Column, regex: str = FILENAME_REGEX,
                   real: Sequence[str] = REAL_TOKENS, ai: Sequence[str] = AI_TOKENS) -> Column:
    """Label from a class word at the start of the file name; a broken regex labels nothing."""
    try:
        groups = re.compile(regex).groups
    except re.error:
        return F.lit(None).cast("int")
    # the match has to begin at the start of the name
    anchored = f"(?i)^(?:{regex})" if not regex.startswith("^") else f"(?i){regex}"
    token = F.regexp_extract(name, anchored, 1 if groups else 0)
    return token_label(F.regexp_replace(token, r"[_\-.]$", ""), real, ai)


def coerce_label(value: Column, kind: str = "string", real: Sequence[str] = REAL_TOKENS,
                 ai: Sequence[str] = AI_TOKENS) -> Column:
    """0/1/NULL from a manifest cell of the given Spark type.

    Numbers count as AI from 0.5 on, but only in a numeric column: in a text
    column "0.83" is not a label.
    """
    if kind == "boolean":
        return value.cast("int")
    if kind in ("tinyint", "smallint", "int", "bigint", "float", "double") \
            or kind.startswith("decimal"):
        number = value.cast("double")
        return F.when(number.isNotNull(), F.when(F.isnan(number), 0)
                      .otherwise((number >= 0.5).cast("int")))
    word = F.lower(F.trim(value.cast("string")))
    return (F.when(word.isin(*YES_WORDS), 1).when(word.isin(*NO_WORDS), 0)
            .otherwise(token_label(word, real, ai)))


def verdict(score: Column, threshold: float) -> Column:
    """"fake" from the threshold on, "real" below, NULL without a score."""
    s = nan_to_null(score)
    return F.when(s >= threshold, "fake").when(s.isNotNull(), "real")


def predicted(score: Column, threshold: float) -> Column:
    return (nan_to_null(score) >= threshold).cast("int")


def result_text(label: Column, pred: Column) -> Column:
    """Correct, false positive, false negative; a dash where either half is missing."""
    return (F.when(label.isNull() | pred.isNull(), "—").when(label == pred, "✓")
            .when(pred == 1, "✗ FP").otherwise("✗ FN"))


def label_text(label: Column) -> Column:
    return F.when(label.isNull(), "—").when(label == 1, "AI").otherwise("Real")


def result_filter(label: Column, pred: Column, kind: str) -> Column:
    """Row filter of a result view: all, ai, real, fp or fn."""
    rules = {
        "all": F.lit(True),
        "ai": pred == 1,
        "real": pred == 0,
        "fp": (pred == 1) & (label == 0),
        "fn": (pred == 0) & (label == 1),
    }
    if kind not in rules:
        raise ValueError(f"unknown filter {kind!r}")
    return F.coalesce(rules[kind], F.lit(False))


def score_band(score: Column) -> Column:
    """Fixed bands below 0.35, below 0.65 and above, whatever the threshold is."""
    s = nan_to_null(score)
    return (F.when(s.isNull(), "none").when(s < 0.35, "real").when(s < 0.65, "warn")
            .otherwise("ai"))


def delta_band(delta: Column) -> Column:
    d = nan_to_null(delta)
    return (F.when(d.isNull(), "none").when(d >= -0.02, "good").when(d >= -0.10, "warn")
            .otherwise("bad"))


def text_or_dash(digits: int, value: Column, unit: str = "") -> Column:
    """Fixed-point text; values that lie exactly halfway go to the even digit."""
    scale = 10.0 ** digits
    exact = value * 1048576.0 == F.floor(value * 1048576.0).cast("double")
    shown = F.when(exact, F.rint(value * scale) / scale).otherwise(value)
    pattern = f"%.{digits}f" + unit.replace("%", "%%")
    return F.when(value.isNotNull(), F.format_string(pattern, shown)).otherwise("—")


def percent_text(value: Column, digits: int = 1) -> Column:
    return text_or_dash(digits, nan_to_null(value) * 100, "%")


def ratio_text(value: Column) -> Column:
    return text_or_dash(3, nan_to_null(value))


def delta_text(delta: Column) -> Column:
    """Signed percentage points."""
    d = nan_to_null(delta)
    sign = F.when(d >= 0, "+").otherwise("−")
    return F.when(d.isNull(), "—").otherwise(
        F.concat(sign, F.format_string("%.1fpp", F.abs(d) * 100)))


def keyword_match(terms: Sequence[str], *columns: Column) -> Column:
    """Any term occurs in the lower-cased, space-joined text columns."""
    text = F.lower(F.concat_ws(" ", *[F.coalesce(c.cast("string"), F.lit("")) for c in columns]))
    words = [t.strip().lower() for t in terms if t.strip()]
    out = F.lit(not words)
    for w in words:
        out = out | text.contains(w)
    return out


def text_columns(names: Sequence[str]) -> list[str]:
    """The columns a keyword filter looks at."""
    return [n for n in names if any(w in n.lower() for w in TEXT_COLUMN_WORDS)]


def resized_url(width: int, *columns: Column) -> Column:
    """First non-empty URL with resize parameters appended."""
    url = F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])
    sep = F.when(url.contains("?"), "&").otherwise("?")
    return F.concat(url, sep, F.lit(f"w={width}&fm=jpg&q=85"))


def group_slug(raw: Column, aliases: dict[str, str] = GENERATOR_ALIASES) -> Column:
    """Stable group name: alias of the bare letters and digits, else a cleaned form."""
    text = F.coalesce(raw.cast("string"), F.lit("None"))
    key = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]", "")
    pairs = [F.lit(x) for kv in sorted(aliases.items()) for x in kv]
    cleaned = F.regexp_replace(F.regexp_replace(text, r"[^\p{L}\p{N}]", "_"), r"^_+|_+$", "")
    known = F.try_element_at(F.create_map(*pairs), key) if pairs else F.lit(None)
    return F.coalesce(known, F.when(cleaned != "", cleaned), F.lit("unknown"))


def readable_size(width: Column, height: Column, most_pixels: int) -> Column:
    return width.cast("bigint") * height.cast("bigint") <= most_pixels


def real_payload(length: Column) -> Column:
    return length >= MIN_PAYLOAD
