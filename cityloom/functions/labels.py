"""Sub class labels, decision notes and traces: column in, column out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cityloom.functions.text import MIXED, NOISE, TEMPORARY, TRANSPORT, UNKNOWN, clean_tag

# Sub class labels by main class, other spellings, canonical labels that no rule gives, and notes.
SUB_LABELS = {
    "住宅类别": ("公共房屋（Public Housing）", "房委会资助出售单位（HA Subsidized Sale Flats）", "私人房屋（Private Housing）", "其他房屋（Other Housing）"),
    "商业类别": ("食肆（Restaurant）", "零售（Retail）", "办公室（Office）", "住宿（Accommodation）", "医疗（Human Health）", "教育（Education）", "数据中心（Data Centre）", "其他商业（Other Commercial）"),
    "工业类别": ("纺织及服装制品（Textile & Wearing Apparel）", "非制造业（Non-manufacturing）", "食品及饮品（Food & Beverage）", "金属及机械（Metal & Machinery）", "其他工业（Other Industrial）"),
    "非评估类别": (NOISE, TRANSPORT, TEMPORARY),
}
SPELLINGS = {"其它商业": "其他商业（Other Commercial）", "其它工业": "其他工业（Other Industrial）", "噪声相关": NOISE, "交通设施": TRANSPORT, "临时设施": TEMPORARY, "杂项设施": TEMPORARY}
CANONICAL = {UNKNOWN: "Unknown", NOISE: "Absolute Noise", TRANSPORT: "Transport Infrastructure", TEMPORARY: "Temporary/Misc Facilities"}
NOTES = (
    (("保留规则确定性结论",), "Rule conclusion retained"),
    (("保留被判定为噪声/非评估的建筑",), "Protected as noise/non-evaluable building"),
    (("全流程未识别,小面积归住宅",), "No rule recognized; small footprint fallback to residential"),
    (("强制兜底为商业",), "Forced fallback to commercial"),
    (("ML推断置信度过低",), "ML confidence too low"),
    (("ML覆盖[", "ML多标签混合"), "ML override with multi-label mixture"),
    (("ML覆盖[", "ML回归精准分配"), "ML override with regression-based subclass allocation"),
    (("ML推断填补-", "ML多标签混合"), "ML completion with multi-label mixture"),
    (("ML推断填补-", "ML回归精准分配"), "ML completion with regression-based subclass allocation"),
)
TRANSPORT_WORDS = "transport|road|rail|flyover|viaduct|bridge|tunnel|交通|道路|铁路|天桥|隧道"
NOISE_WORDS = "noise|sound|barrier|outfall|lighthouse|噪声|噪音|屏障|排污口|灯塔|燈塔"

_CHINESE, _LATIN = r"[\x{4e00}-\x{9fff}]", "[A-Za-z]"
#: A dash between labels; those within Non-manufacturing, Non-assessed and Mixed-use are none.
SEPARATOR = "(?<!Non|Mixed)-"


def _table(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for p in sorted(pairs.items()) for x in p])


def _plain(c: Column) -> Column:
    """Half-width brackets, single spaces."""
    return F.regexp_replace(F.translate(F.trim(c), "（）", "()"), r"\s+", " ")


def standard_table() -> dict[str, str]:
    """Label by plain spelling: whole, or only what stands before the bracket."""
    out = {s: label for s, label in SPELLINGS.items()}
    for label in (label for labels in SUB_LABELS.values() for label in labels):
        out[label.replace("（", "(").replace("）", ")")] = label
        out[label.split("（")[0]] = label
    return out


def main_of_sub() -> Column:
    """Map from a sub class, whole or only its Chinese part, to its main class."""
    return _table({key: main for main, labels in SUB_LABELS.items() for label in labels for key in (label, label.split("（")[0])})


def std_sub(c: Column) -> Column:
    """Standard sub class of a label in any brackets and spacing, by its Chinese part if need be; else, and for null, unknown."""
    table, plain = _table(standard_table()), _plain(c)
    return F.coalesce(table[plain], table[F.trim(F.regexp_extract(plain, r"^([^()]+)", 1))], F.lit(UNKNOWN))


def std_subs(c: Column) -> Column:
    """List mode: standard labels of the parts of ``label:share-label:share``, joined by dashes; without any: mixed use."""
    known = F.filter(F.transform(F.split(c, SEPARATOR), lambda p: std_sub(F.substring_index(p, ":", 1))), lambda s: s != UNKNOWN)
    return F.when(c.isNull() | (F.size(known) == 0), F.lit(MIXED)).otherwise(F.array_join(known, "-"))


def canonical_table() -> dict[str, str]:
    """``EN_ZH`` by either part, and by the standard label."""
    both = {zh: (en, zh) for zh, en in CANONICAL.items()}
    for label in (label for labels in SUB_LABELS.values() for label in labels if "（" in label):
        both[label] = (label.split("（")[1].rstrip("）"), label.split("（")[0])
    return {key: f"{en}_{zh}" for label, (en, zh) in both.items() for key in (label, en, zh)}


def _swapped(c: Column) -> Column:
    """``EN_ZH`` of ``ZH（EN）`` and ``EN（ZH）``; other texts stay."""
    a, b = F.trim(F.regexp_extract(_plain(c), r"^([^()]+)\(([^()]+)\)$", 1)), F.trim(F.regexp_extract(_plain(c), r"^([^()]+)\(([^()]+)\)$", 2))
    return F.when(a.rlike(_CHINESE) & b.rlike(_LATIN), F.concat(b, F.lit("_"), a)).when(a.rlike(_LATIN) & b.rlike(_CHINESE), F.concat(a, F.lit("_"), b)).otherwise(F.trim(c))


def canon_sub(c: Column) -> Column:
    """Canonical ``EN_ZH`` of a sub class; null and empty are unknown, unknown spellings only have their brackets resolved."""
    table, t = _table(canonical_table()), F.trim(F.coalesce(c, F.lit("")))
    n = _swapped(t)
    paired = n.rlike(rf"{_LATIN}.*_.*{_CHINESE}")
    halves = F.coalesce(table[F.trim(F.substring_index(n, "_", 1))], table[F.trim(F.substring_index(n, "_", -1))])
    return F.when(t == "", F.lit("Unknown_未知类别")).otherwise(F.coalesce(table[t], F.when(paired, halves), n))


def canon_subs(c: Column) -> Column:
    """List mode: ``label:share`` parts keep their shares."""
    parts = F.filter(F.split(F.trim(F.coalesce(c, F.lit(""))), SEPARATOR), lambda p: F.trim(p) != "")
    one = lambda p: F.when(F.contains(p, F.lit(":")), F.concat(canon_sub(F.substring_index(p, ":", 1)), F.lit(":"), F.trim(F.regexp_extract(p, ":(.*)$", 1)))).otherwise(canon_sub(p))
    return F.when(F.size(parts) == 0, F.lit("Unknown_未知类别")).otherwise(F.array_join(F.transform(parts, one), "-"))


def note_bilingual(c: Column) -> Column:
    """Note with an English phrase before it; empty and bilingual ones stay, null is empty."""
    t = F.trim(F.coalesce(c, F.lit("")))
    phrase = F.lit("Pipeline decision note")
    for words, english in reversed(NOTES):
        hit = F.contains(t, F.lit(words[0]))
        for w in words[1:]:
            hit = hit & F.contains(t, F.lit(w))
        phrase = F.when(hit, F.lit(english)).otherwise(phrase)
    done = F.substring_index(t, "_", 1).rlike(_LATIN) & F.contains(t, F.lit("_")) & F.regexp_extract(t, "_(.*)$", 1).rlike(_CHINESE)
    return F.when((t == "") | done, t).otherwise(F.concat(phrase, F.lit("_"), t))


def override_reason(c: Column) -> Column:
    """What stands in the brackets of an override note; null without one."""
    return F.nullif(F.regexp_extract(c, r"ML覆盖\[(.*?)\]", 1), F.lit(""))


def non_assessed_sub(text: Column) -> Column:
    """Canonical sub class of a non-assessed building by all its texts."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.when(low.rlike(TRANSPORT_WORDS), "Transport Infrastructure_交通基础设施").when(low.rlike(NOISE_WORDS), "Noise-related Infrastructure_噪声相关基础设施").otherwise("Temporary/Miscellaneous Structures_临时/杂项设施")


def poi_tag(amenity: Column, shop: Column, building: Column) -> Column:
    """First tag that says something; a building tag is marked as such."""
    b = F.nullif(clean_tag(building), F.lit(""))
    return F.coalesce(F.nullif(clean_tag(amenity), F.lit("")), F.nullif(clean_tag(shop), F.lit("")), F.concat(F.lit("building:"), b))


def poi_label(name: Column, tag: Column, sub: Column) -> Column:
    """``name[tag->class]`` of a classified POI."""
    called = F.coalesce(F.nullif(F.trim(name), F.lit("")), F.lit("Unnamed_POI"))
    return F.concat(called, F.lit("["), F.coalesce(F.concat(tag, F.lit("->")), F.lit("")), sub, F.lit("]"))
