"""Personal data by weak supervision: labelers vote on candidate spans, their reliabilities are estimated, a classifier decides.

Candidates are found by regular expressions with their places. Base candidates (e-mail, IP, card and phone numbers of the stated
forms) always stay. For the looser ones, regex, gazetteer and context labelers vote for, against or not at all. Expectation
maximisation over the counts of vote patterns estimates how reliable each labeler is and how likely each pattern is personal
data; a logistic span classifier is trained on those shares and decides. Everything that touches rows is made of DataFrame
functions; only the counts of the patterns, of which there are a bounded number, reach the driver.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cityloom.llm.common import write_table

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret", "ssn", "account")
_LOCAL = "A-Za-z0-9._%+-"
_PART = "0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{0,2})"
#: The base forms. A match starts where the last one ended or where a run begins, which is where a leftmost match can start, and
#: possessive repeats keep long runs from being tried again from every place in them.
PATTERNS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
_NAMED = "(?:password|passwd|pwd|secret|token|api[_-]?key)"
#: Looser forms: kind, pattern, what a text must contain to be looked at.
LOOSE = (
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{2,}+ ?[\[(]at[\])] ?[A-Za-z0-9-]{2,}+(?: ?[\[(]dot[\])] ?[A-Za-z0-9-]{2,}+)++", r"[\[(]at[\])]"),
    ("phone", r"(?<![0-9A-Za-z+./-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z-])", r"[0-9]{3}[ .-][0-9]{4}"),
    ("secret", r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[0-9A-Z]{16}(?![A-Za-z0-9])", "(?:AKIA|ASIA)[0-9A-Z]"),
    # a quoted value alone
    ("secret", rf"(?i)(?<={_NAMED} ?[=:] ?[\"'])[^\"'\n]{{6,}}+(?=[\"'])", rf"(?i){_NAMED} ?[=:]"),
    # and with its name, from that to the value's last sign that is no punctuation
    ("secret", rf"(?i)(?<![a-z0-9]){_NAMED} ?[=:] ?[\"']?[^\s,;\"']{{5,}}[A-Za-z0-9/+=_-]", rf"(?i){_NAMED} ?[=:]"),
    # long runs of letters and digits without a name before them: keys, or hashes, or mere numbers of parts
    ("secret", r"(?<![A-Za-z0-9_/.-])(?=[A-Za-z_-]*+[0-9])(?=[0-9_-]*+[A-Za-z])[A-Za-z0-9_-]{24,}+(?![A-Za-z0-9/.])", "[A-Za-z0-9_-]{24}"),
    # card numbers whose check digit is wrong, or numbers of something else
    ("account", r"(?<![0-9A-Za-z.+/-])[0-9]{4}(?:[ -]?[0-9]{4}){2,3}[0-9]{0,3}(?![0-9A-Za-z])", "[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}"),
    # four parts of which one is too large, or more parts: hardly an address
    ("ip", r"(?<![0-9.])[0-9]{1,4}(?:\.[0-9]{1,4}){3,5}(?![0-9.])", r"[0-9]\.[0-9]{1,4}\.[0-9]{1,4}\.[0-9]"),
    ("ssn", r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])", r"[0-9]-[0-9]{2}-[0-9]"),
)
#: Gazetteers: what a span of the kind holds if it is one, and what speaks against it.
GAZETTEER = {
    "email": (r"(?i)(?:\.|dot[\])] ?)(?:com|org|net|edu|gov|io|de|fr|es|uk|info|eu)\b", r"(?i)\b(?:noreply|no-reply|nobody)\b"),
    "ip": (r"^(?:[1-9]|[1-9][0-9]|1[0-9][0-9]|2[0-1][0-9]|22[0-3])\.", r"^(?:0|127|255)\."),
    "card": (r"^[3-6]", r"^(?:0|1|9)"),
    "phone": (r"^\(?[2-9][0-9]{2}", r"^\(?(?:000|111|123)"),
    "secret": (r"^(?:AKIA|ASIA|gh[pousr]_|sk-|xox[bp]-|eyJ)|(?i:(?:^|[\"' =:])[0-9a-f]{32,}$)", r"(?i)^(?:none|null|true|false|xxx+|changeme|example|undefined|required|redacted)|(?:^|[_-])(?:test|dummy|sample)"),
    "ssn": (r"^(?!000|666|9)[0-9]", r"^(?:000|666|9)|-00-|-0000$"),
    "account": (r"^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5))", r"^(?:0|1|7|8|9)|^(?:19|20)[0-9]{2}(?:0[1-9]|1[0-2])"),
}
#: Words shortly before a span that speak for a kind, and ones that speak against any.
CONTEXT = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|write|reach)\b",
    "ip": r"(?i)\b(?:ip|host|server|address|from)\b",
    "card": r"(?i)\b(?:card|visa|mastercard|credit|debit|payment)\b",
    "phone": r"(?i)\b(?:phone|tel|call|mobile|cell|fax|contact)\b",
    "secret": r"(?i)(?:key|secret|login|credential|access|auth|aws|token|passw(?:or)?d|pwd)\b",
    "ssn": r"(?i)\b(?:ssn|social|security|insured)\b",
    "account": r"(?i)\b(?:account|acct|iban|card|visa|mastercard|credit|debit|payment)\b",
}
AGAINST = r"(?i)\b(?:version|isbn|issn|figure|table|section|chapter|page|doi|order|serial|commit|sha|sha1|sha256|md5|hash|checksum|digest|revision|invoice|tracking|sku|build)\b"
LABELERS = ("regex", "gazetteer", "context", "shape", "check")


def located(text: Column, pattern: str, wanted: Column) -> tuple[Column, Column]:
    """(matches of pattern, the pieces between them), both empty where wanted is not true."""
    none = F.array().cast("array<string>")
    return F.when(wanted, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none), F.when(wanted, F.split(text, pattern, -1)).otherwise(none)


def places(matches: Column, pieces: Column) -> Column:
    """Array of (s, e, t): start, end (exclusive, code points) and text of each match."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<s:int,e:int,t:string>>").alias("out"))

    def step(acc: Column, i: Column) -> Column:
        t = F.get(matches, i)
        s = acc["at"] + F.length(F.get(pieces, i))
        e = s + F.length(t)
        return F.struct(e.alias("at"), F.concat(acc["out"], F.array(F.struct(s.alias("s"), e.alias("e"), t.alias("t")))).alias("out"))

    many = F.size(matches)
    return F.when(many > 0, F.aggregate(F.sequence(F.lit(0), F.greatest(many - 1, F.lit(0))), start, step, lambda acc: acc["out"])).otherwise(F.array().cast("array<struct<s:int,e:int,t:string>>"))


def _luhn(digits: Column) -> Column:
    def value(i: Column) -> Column:
        d = F.substr(digits, F.length(digits) - i, F.lit(1)).cast("int")
        return F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.transform(F.sequence(F.lit(0), F.length(digits) - 1), value), F.lit(0), lambda a, b: a + b) % 10 == 0


def base_valid(kind: str, t: Column) -> Column:
    digits = F.regexp_replace(t, "[^0-9]", "")
    if kind == "ip":
        return t.rlike(rf"^{_PART}\.{_PART}\.{_PART}\.{_PART}$")
    if kind == "card":
        return F.length(digits).between(13, 19) & F.when(F.length(digits).between(13, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _vote(yes: Column, no: Column) -> Column:
    """1 for, 0 against, -1 neither."""
    return F.when(no, 0).when(yes, 1).otherwise(-1)


def _votes(kind: str, span: Column, text: Column) -> list[Column]:
    t = span["t"]
    before = F.substr(text, F.greatest(span["s"] - 39, F.lit(1)), F.least(span["s"], F.lit(40)))
    good, bad = GAZETTEER[kind]
    digits = F.length(F.regexp_replace(t, "[^0-9]", ""))
    kinds = F.size(F.array_distinct(F.split(t, "")))
    strict = {"email": t.rlike(r"^\S+ [\[(]at[\])] \S+(?: [\[(]dot[\])] \S+)+$"), "phone": t.rlike(r"^\([0-9]{3}\) |^([0-9]{3})([.-])[0-9]{3}\2[0-9]{4}$"), "secret": t.rlike(r"[0-9]") & t.rlike("[A-Za-z]"), "ssn": digits == 9, "account": digits.isin(15, 16)}.get(kind, F.lit(True))
    wrong = {"ip": ~t.rlike(r"^[0-9]+(?:\.[0-9]+){3}$"), "account": digits < 13}.get(kind, F.lit(False))
    few = {"account": 6, "ip": 3}.get(kind, 8)
    context = F.when(before.rlike(AGAINST), 0).when(before.rlike(CONTEXT[kind]), 1).otherwise(-1)
    return [_vote(strict & ~wrong, wrong), _vote(t.rlike(good), t.rlike(bad)), context, _vote(kinds >= few, kinds < few - 1), _checked(kind, t)]


def _checked(kind: str, t: Column) -> Column:
    """The sums and ranges that numbers of a kind keep: for if kept, against if not, nothing for other kinds."""
    if kind == "account":
        return F.when(_luhn(F.regexp_replace(t, "[^0-9]", "")), 1).otherwise(0)
    if kind == "ip":
        return F.when(base_valid("ip", t), 1).otherwise(0)
    if kind == "secret":  # letters and digits in turns, as in no word
        turns = F.length(F.regexp_replace(F.regexp_replace(t, "[A-Za-z]+", "a"), "[0-9]+", "0"))
        return F.when(turns >= 6, 1).when(turns <= 2, 0).otherwise(-1)
    return F.lit(-1)


def _span(kind: str, x: Column, *more: Column) -> Column:
    return F.struct(F.lit(KINDS.index(kind)).alias("k"), x["s"].alias("s"), x["e"].alias("e"), *more)


def _base_spans(kind: str) -> Column:
    return F.transform(F.filter(f"s_{kind}", lambda x: base_valid(kind, x["t"])), lambda x: _span(kind, x))


def _loose_spans(n: int, kind: str) -> Column:
    apart = F.filter(f"s_{n}", lambda x: ~F.exists("base", lambda b: (b["s"] <= x["s"]) & (x["e"] <= b["e"])))
    return F.transform(apart, lambda x: _span(kind, x, F.array(*_votes(kind, x, F.col("text"))).alias("votes"), F.least(F.length(x["t"]) / 8, F.lit(4)).cast("int").alias("size")))


def candidates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, base, loose``: base spans (k, s, e) in order, and loose spans (k, s, e, votes, size) that no base span holds."""
    d = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    digits = F.col("text").rlike("[0-9]")
    wanted = {"email": F.contains("text", F.lit("@")), "ip": digits, "card": digits, "phone": digits & F.contains("text", F.lit("+"))}
    d = d.withColumns({f"w_{k}": w for k, w in wanted.items()})
    found = {}
    for k in BASE:
        found[f"m_{k}"], found[f"p_{k}"] = located(F.col("text"), PATTERNS[k], F.col(f"w_{k}"))
    for n, (_, pattern, hint) in enumerate(LOOSE):
        found[f"m_{n}"], found[f"p_{n}"] = located(F.col("text"), pattern, F.col("text").rlike(hint))
    d = d.withColumns(found)
    d = d.withColumns({f"s_{k}": places(F.col(f"m_{k}"), F.col(f"p_{k}")) for k in (*BASE, *range(len(LOOSE)))})
    d = d.withColumn("base", F.concat(*[_base_spans(k) for k in BASE]))
    loose = [_loose_spans(n, kind) for n, (kind, _, _) in enumerate(LOOSE)]
    return d.select("id", "base", F.array_distinct(F.concat(*loose)).alias("loose"))


def reliabilities(patterns: list[tuple[int, tuple[int, ...], int]], rounds: int = 60, prior: float = 0.6) -> tuple[dict, dict]:
    """Expectation maximisation over (kind, votes, count): ((kind, labeler, vote): share if personal, if not), and (kind, votes): share.

    Each labeler starts as better than chance and keeps a weight of a few imaginary votes, so that a kind with few spans, or one
    whose labelers all agree, does not run off to certainty.
    """
    start = {1: (0.6, 0.15), 0: (0.1, 0.5), -1: (0.3, 0.35)}
    labelers = max((len(v) for _, v, _ in patterns), default=len(LABELERS))
    rely = {(k, n, v): start[v] for k in range(len(KINDS)) for n in range(labelers) for v in (1, 0, -1)}
    share = {k: prior for k in range(len(KINDS))}
    post: dict = {}
    for _ in range(rounds):
        for k, votes, _n in patterns:
            a, b = math.log(share[k]), math.log(1 - share[k])
            for n, v in enumerate(votes):
                a, b = a + math.log(rely[k, n, v][0]), b + math.log(rely[k, n, v][1])
            post[k, votes] = 1 / (1 + math.exp(max(-60, min(60, b - a))))
        for k in {p[0] for p in patterns}:
            own = [(v, c) for kk, v, c in patterns if kk == k]
            yes = sum(c * post[k, v] for v, c in own)
            no = sum(c * (1 - post[k, v]) for v, c in own)
            share[k] = min(0.98, max(0.02, (yes + 10 * prior) / (yes + no + 10)))
            for n in range(labelers):
                for x in (1, 0, -1):
                    hit = [(v, c) for v, c in own if v[n] == x]
                    rely[k, n, x] = ((sum(c * post[k, v] for v, c in hit) + 20 * start[x][0]) / (yes + 20), (sum(c * (1 - post[k, v]) for v, c in hit) + 20 * start[x][1]) / (no + 20))
    return rely, post


def span_classifier(rows: list[tuple[int, tuple[int, ...], int, int]], post: dict, steps: int = 400, rate: float = 0.5) -> dict:
    """Logistic weights of features of (kind, votes, size, count), fitted to the shares in post: feature name: weight."""
    weights: dict = {}

    def features(k: int, votes: tuple[int, ...], size: int) -> list:
        return ["bias", ("kind", k), ("size", size)] + [(n, v) for n, v in enumerate(votes) if v >= 0]

    total = sum(c for *_, c in rows) or 1
    for _ in range(steps):
        slope: dict = {}
        for k, votes, size, c in rows:
            own = features(k, votes, size)
            p = 1 / (1 + math.exp(-max(-30, min(30, sum(weights.get(f, 0) for f in own)))))
            for f in own:
                slope[f] = slope.get(f, 0) + (post[k, votes] - p) * c / total
        for f, g in slope.items():
            weights[f] = weights.get(f, 0) + rate * (g - 1e-4 * weights.get(f, 0))
    return weights


def _probability(span: Column, weights: dict) -> Column:
    z = F.lit(float(weights.get("bias", 0)))
    for f, w in weights.items():
        if f == "bias":
            continue
        name, value = f
        field = span["k"] if name == "kind" else span["size"] if name == "size" else F.get(span["votes"], F.lit(name))
        z = z + F.when(field == value, float(w)).otherwise(0.0)
    return 1 / (1 + F.exp(-z))


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat(F.get(names, x["k"]), F.lit(":"), x["s"].cast("string"), F.lit(":"), x["e"].cast("string"))), ",")


def find_pii(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, base, spans`` (arrays of k, s, e: kind by place in KINDS, start, end in code points), ``base_text, spans_text``.

    One row per row of df. Null text is empty, empty texts have no spans; repeated rows get equal results, null ids stay; texts of
    any length are searched whole, and ties of spans stay side by side, in order of kind, start and end. Base
    spans are leftmost non-overlapping matches of each kind that pass its test; failing matches are dropped without another
    try. An empty table gives an empty result; other columns are not read.
    """
    table = write_table(candidates(df, id_col, text_col), "candidates")
    seen = table.select(F.explode("loose").alias("x")).groupBy("x.k", "x.votes", "x.size").count().collect()
    rows = sorted((r["k"], tuple(r["votes"]), r["size"], r["count"]) for r in seen)
    counts: dict = {}
    for k, votes, _, c in rows:
        counts[k, votes] = counts.get((k, votes), 0) + c
    _, post = reliabilities([(k, v, c) for (k, v), c in sorted(counts.items())])
    weights = span_classifier(rows, post)
    added = F.transform(F.filter("loose", lambda x: _probability(x, weights) >= 0.5), lambda x: F.struct(x["k"].alias("k"), x["s"].alias("s"), x["e"].alias("e")))
    out = table.select("id", F.array_sort("base").alias("base"), F.array_sort(F.concat("base", added)).alias("spans"))
    return out.withColumns({"base_text": _joined(F.col("base")), "spans_text": _joined(F.col("spans"))})
