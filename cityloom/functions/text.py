"""Text and label functions: column in, column out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Labels of the classification.
RESIDENTIAL, COMMERCIAL, INDUSTRIAL, NON_ASSESSED, MIXED, UNKNOWN = "住宅类别", "商业类别", "工业类别", "非评估类别", "混合用途", "未知类别"
PUBLIC_HOUSING, PRIVATE_HOUSING, OTHER_HOUSING = "公共房屋（Public Housing）", "私人房屋（Private Housing）", "其他房屋（Other Housing）"
RESTAURANT, RETAIL, OFFICE, HEALTH, EDUCATION, OTHER_COMMERCIAL = "食肆（Restaurant）", "零售（Retail）", "办公室（Office）", "医疗（Human Health）", "教育（Education）", "其他商业（Other Commercial）"
OTHER_INDUSTRIAL, NON_MANUFACTURING = "其他工业（Other Industrial）", "非制造业（Non-manufacturing）"
NOISE, TRANSPORT, TEMPORARY = "绝对噪声相关", "交通基础设施", "临时/杂项设施"
# Words and labels by which texts are classified.
#: Registry usage texts, the first group that occurs decides.
REGISTRY_WORDS = (
    (("寫字樓", "商業", "Office", "Commercial"), COMMERCIAL, OFFICE),
    (("住宅", "綜合用途", "Residential", "Composite"), RESIDENTIAL, PRIVATE_HOUSING),
    (("幼稚園", "學校", "教育", "School", "Kindergarten", "Secondary"), COMMERCIAL, EDUCATION),
    (("醫院", "診所", "Medical", "Hospital", "Clinic"), COMMERCIAL, HEALTH),
    (("工業", "工廠", "Industrial", "Factory"), INDUSTRIAL, OTHER_INDUSTRIAL),
)
#: Place categories: words, tag column, tag.
PLACE_WORDS = (
    (("restaurant", "cafe", "food", "bar", "dining", "bakery", "coffee"), "amenity", "restaurant"),
    (("retail", "shop", "store", "market", "grocery", "boutique", "supermarket", "convenience", "mall"), "shop", "retail"),
    (("office", "corporate", "company", "agency"), "shop", "office"),
    (("hotel", "accommodation"), "amenity", "hotel"),
    (("hospital", "clinic"), "amenity", "hospital"),
    (("school", "education"), "amenity", "school"),
)
#: Canonical main labels: English word, Chinese word, label.
MAIN_LABELS = (
    ("residential", "住宅", "Residential_住宅类别"),
    ("commercial", "商业", "Commercial_商业类别"),
    ("industrial", "工业", "Industrial_工业类别"),
    ("mixed[- ]use", "混合", "Mixed-use_混合用途"),
    ("non[- ]assessed", "非评估", "Non-assessed_非评估类别"),
    ("unknown", "未知", "Unknown_未知类别"),
)
DEFAULT_SUB = {RESIDENTIAL: PRIVATE_HOUSING, COMMERCIAL: OTHER_COMMERCIAL, INDUSTRIAL: OTHER_INDUSTRIAL, NON_ASSESSED: TEMPORARY}


def clean_tag(c: Column) -> Column:
    """Trimmed tag; nan, none, null and null are empty."""
    t = F.trim(F.coalesce(c.cast("string"), F.lit("")))
    return F.when(F.lower(t).isin("nan", "none", "null", ""), F.lit("")).otherwise(t)


def normalize_id(c: Column) -> Column:
    """Id as text without blanks and without a trailing .0; missing ones are empty."""
    t = F.regexp_replace(F.trim(F.coalesce(c.cast("string"), F.lit(""))), r"\.0$", "")
    return F.when(F.lower(t).isin("nan", "none", "null"), F.lit("")).otherwise(t)


def safe_number(c: Column, default: float | None = None) -> Column:
    """Number of a text; what is none, NaN included, is the default."""
    n = c.cast("string").try_cast("double")
    n = F.when(F.isnan(n), F.lit(None).cast("double")).otherwise(n)
    return n if default is None else F.coalesce(n, F.lit(float(default)))


def op_year(c: Column) -> Column:
    return F.year(F.try_to_timestamp(c))


def ordered_class(c: Column, groups: tuple, pick: int) -> Column:
    out = F.lit(None).cast("string")
    for words, *values in reversed(groups):
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(c, F.lit(w))
        out = F.when(hit, F.lit(values[pick])).otherwise(out)
    return out


def registry_class(c: Column) -> tuple[Column, Column]:
    """(main, sub) of a registry usage text; null if no word occurs."""
    return ordered_class(c, REGISTRY_WORDS, 0), ordered_class(c, REGISTRY_WORDS, 1)


def place_bucket(c: Column) -> tuple[Column, Column]:
    """(amenity, shop) of a place category; without a known word the category itself is the amenity."""
    low = F.lower(c)
    kind, tag = ordered_class(low, PLACE_WORDS, 0), ordered_class(low, PLACE_WORDS, 1)
    return F.when(kind.isNull(), F.nullif(low, F.lit(""))).when(kind == "amenity", tag), F.when(kind == "shop", tag)


def fold_script(c: Column, traditional: str, simplified: str) -> Column:
    """Character by character fold of traditional to simplified script."""
    return F.translate(c, traditional, simplified)


def keyword_pattern(keywords: list[str], latin_word_boundary: bool = True) -> str:
    """One alternation, longest keyword first, without those of one character; Latin keywords match whole words if asked."""
    parts = []
    for k in sorted({k for k in keywords if len(k.strip()) > 1}, key=lambda k: (-len(k), k)):
        quoted = "".join("\\" + ch if not ch.isalnum() and ch != " " else ch for ch in k.lower())
        parts.append(rf"\b{quoted}\b" if latin_word_boundary and k.isascii() else quoted)
    return "(?U)" + ("|".join(parts) or "(?!)")


def keyword_hits(c: Column, keywords: list[str], latin_word_boundary: bool = True, fold: tuple[str, str] = ("", "")) -> Column:
    """All keywords of a text from left to right, the longest at a place; fold (traditional, simplified) is applied to the text and the keywords before."""
    table = str.maketrans(*fold)
    keywords = [k.translate(table) for k in keywords]
    c = fold_script(c, *fold) if fold[0] else c
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(keyword_pattern(keywords, latin_word_boundary)), F.lit(0))


def canon_main(c: Column) -> Column:
    """Canonical bilingual main label; other texts stay."""
    t = F.trim(F.coalesce(c, F.lit("")))
    out = t
    for english, chinese, label in reversed(MAIN_LABELS):
        out = F.when(F.lower(t).rlike(english) | F.contains(t, F.lit(chinese)), F.lit(label)).otherwise(out)
    return F.when(t == "", F.lit("Unknown_未知类别")).otherwise(out)


def std_main(c: Column) -> Column:
    """Known main class, else unknown."""
    return F.when(F.contains(c, F.lit(MIXED)), F.lit(MIXED)).when(c.isin(RESIDENTIAL, COMMERCIAL, INDUSTRIAL, NON_ASSESSED), c).otherwise(F.lit(UNKNOWN))


def ml_target(c: Column) -> Column:
    """One of the three classes that models learn, or null."""
    m = canon_main(c)
    return F.when(m.startswith("Residential"), "residential").when(m.startswith("Commercial"), "commercial").when(m.startswith("Industrial"), "industrial")


def norm_label(c: Column) -> Column:
    """Full-width brackets, single spaces, no blanks or dashes at the ends."""
    return F.regexp_replace(F.regexp_replace(F.translate(c, "()", "（）"), r"\s+", " "), r"^[ -]+|[ -]+$", "")


def label_english(c: Column) -> Column:
    """English part of ``EN_ZH`` or ``ZH（EN）``."""
    inner = F.regexp_extract(c, "（([^（）]*)）", 1)
    return F.when(inner != "", inner).otherwise(F.substring_index(c, "_", 1))


def block_numbers(c: Column) -> Column:
    """Numbers of ``Block n`` and ``第n座``."""
    both = F.concat(F.regexp_extract_all(c, F.lit(r"(?i)block\s*([0-9]+)"), F.lit(1)), F.regexp_extract_all(c, F.lit("第\\s*([0-9]+)\\s*座"), F.lit(1)))
    return F.array_distinct(F.transform(both, lambda x: x.cast("int")))


def meaningful_length(c: Column) -> Column:
    return F.length(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)[0-9\s\W_]+", ""))


def format_vector(m: Column) -> Column:
    """``label:0.00`` by falling share, then label, joined by dashes."""
    rows = F.array_sort(F.transform(F.map_entries(m), lambda e: F.struct((-e["value"]).alias("v"), e["key"].alias("k"))))
    return F.array_join(F.transform(rows, lambda r: F.concat(r["k"], F.lit(":"), F.format_string("%.2f", F.bround(-r["v"], 2)))), "-")


def parse_vector(c: Column) -> Column:
    """Map of a text that format_vector made; dashes within labels stay."""
    pattern = r"(.+?):([0-9]+(?:\.[0-9]+)?)(?:-|$)"
    keys, values = F.regexp_extract_all(c, F.lit(pattern), F.lit(1)), F.regexp_extract_all(c, F.lit(pattern), F.lit(2))
    return F.map_filter(F.map_from_arrays(keys, F.transform(values, lambda v: v.cast("double"))), lambda _, v: v > 0)


def dominant_label(m: Column) -> Column:
    """Label of the largest share, the first by name among equal ones."""
    return F.get(F.array_sort(F.transform(F.map_entries(m), lambda e: F.struct((-e["value"]).alias("v"), e["key"].alias("k")))), F.lit(0))["k"]


def relabel_vector(m: Column, labels: Column) -> Column:
    return F.transform_keys(m, lambda k, _: F.coalesce(labels[k], k))


def extract_json(c: Column) -> Column:
    """The outermost braces of a free text."""
    return F.nullif(F.regexp_extract(c, r"(?s)\{.*\}", 0), F.lit(""))


def norm_verdict(c: Column) -> Column:
    low = F.lower(c)
    return F.when(F.contains(low, F.lit("keep")), "keep").when(F.contains(low, F.lit("merge")), "merge").when(F.contains(low, F.lit("delete")), "delete").otherwise("error")
