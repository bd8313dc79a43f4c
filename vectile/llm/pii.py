"""Personal data by candidate generation and boosted trees. Built-in functions only.

Fixed patterns give the base spans. Wider generators propose further spans, which may overlap them: obfuscated mail addresses,
IPv6-like groups, long digit runs, telephone numbers without a plus. Boosted trees over format and context score the
candidates, and a threshold calibrated for each kind selects those to redact as well. They learn from evidence that is no
feature: an address that parses, eight groups, a check sum, a plus. The plus only shows some telephone numbers, so
for them the share of true candidates is estimated from the share that has it.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectile.llm.common import packed, whole_text
from vectile.llm.rules import let

KINDS = ("email", "ip", "card", "phone")

# The base patterns are fixed by the contract. Written so that every start that must fail fails at once: possessive runs,
# and no start inside a run (\G allows one where the match before ended).
LOCAL = r"[A-Za-z0-9._%+-]"
BASE = (
    rf"(?:(?<!{LOCAL})|\G){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){15,18}+(?![ -]?[0-9])",
    r"\+[0-9][ ().0-9-]+[0-9]",
)
GENERATORS = (
    rf"(?<!{LOCAL}){LOCAL}++ ?(?:@|\(at\)|\[at\]|(?<= )at(?= )) ?[A-Za-z0-9-]++(?: ?(?:\.|\(dot\)|\[dot\]|(?<= )dot(?= )) ?[A-Za-z0-9-]++)++",
    r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){3,7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,18}+(?![ -]?[0-9])",
    r"(?<![0-9])(?<![0-9][ -.])\(?[0-9](?:[ ().-]{0,2}[0-9]){6,14}+(?![ .-]?[0-9])",
)
CONTEXT = (r"\b(?:e?-?mail|contact|write to)", r"\b(?:ip\b|host|server|addr)", r"\b(?:card|visa|credit|debit)", r"\b(?:(?:tele)?phone|tel\b|call|fax|mobile|dial)")
OCTETS = "^" + r"\.".join(["0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"] * 4) + "$"
# Syntax of an address (its last part is a country's two letters or a general name), known issuers of cards with their
# lengths, layouts of telephone numbers.
ADDRESS = r"^[a-z0-9](?:[a-z0-9_%+-]|\.(?=[a-z0-9_%+-]))*@(?:[a-z0-9](?:[a-z0-9-]*[a-z0-9])?\.)+(?:[a-z]{2}|com|org|net|edu|gov|mil|int|info|biz|name|pro|app|dev|online|site|shop)$"
ISSUERS = r"^(?:4[0-9]{12}|4[0-9]{15}|4[0-9]{18}|3[47][0-9]{13}|3(?:0[0-5]|[68][0-9])[0-9]{11}|5[1-5][0-9]{14}|2[2-7][0-9]{14}|35[0-9]{14}|6[0-9]{15,18})$"
LAYOUTS = (r"^(?:[0-9]{1,3}[ .-]?)?\([0-9]{2,4}\) ?[0-9]{3,4}[ .-]?[0-9]{3,4}$", r"^(?:[0-9]{1,3}[ .-])?[0-9]{3}([ .-])[0-9]{3}\1[0-9]{4}$")
NEAR = 24
FEATURES = ("kind", "digits", "breaks", "letters", "context", "before", "after", "form")
EMAIL, IP, CARD, PHONE = range(len(KINDS))


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the digits pass the check sum: from the right, every second digit is doubled and its digits are added."""
    values = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 1, F.get(F.array(*[F.lit(2 * x // 10 + 2 * x % 10) for x in range(10)]), d.cast("int"))).otherwise(d.cast("int")))
    return F.aggregate(values, F.lit(0), lambda a, b: a + F.coalesce(b, F.lit(0))) % 10 == 0


def matches(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches as (start, end, match, before, after), in code points, end exclusive.

    The text is cut at the matches, so that positions are running sums of lengths and no text is searched for a position.
    """
    cut = F.struct(F.split(text, pattern, -1).alias("rest"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"))

    def placed(c: Column) -> Column:
        step = lambda acc, i: F.struct(
            (acc["at"] + F.length(F.get(c["rest"], i)) + F.length(F.get(c["found"], i))).alias("at"),
            F.concat(acc["starts"], F.array(acc["at"] + F.length(F.get(c["rest"], i)))).alias("starts"),
        )
        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
        starts = F.aggregate(F.sequence(F.lit(0), F.size(c["found"]) - 1), zero, step, lambda acc: acc["starts"])
        span = lambda s, i: F.struct(
            s.alias("start"),
            (s + F.length(F.get(c["found"], i))).alias("end"),
            F.get(c["found"], i).alias("match"),
            F.lower(F.right(F.get(c["rest"], i), F.lit(NEAR))).alias("before"),
            F.left(F.get(c["rest"], i + 1), F.lit(1)).alias("after"),
        )
        return F.transform(starts, span)

    none = F.array().cast("array<struct<start:int,end:int,match:string,before:string,after:string>>")
    return let(cut, lambda c: F.when(F.size(c["found"]) > 0, placed(c)).otherwise(none))


def base_spans(text: Column) -> list[Column]:
    """The spans of each kind that pass its check; a failing match is dropped and not tried again."""
    size = lambda m: F.length(_digits(m["match"]))
    keep = (
        lambda m: F.lit(True),
        lambda m: m["match"].rlike(OCTETS),
        lambda m: size(m).between(16, 19) & luhn(_digits(m["match"])),
        lambda m: size(m).between(8, 15),
    )
    # A text without the character that a kind needs is not searched.
    need = (F.contains(text, F.lit("@")), F.contains(text, F.lit(".")), F.lit(True), F.contains(text, F.lit("+")))
    none = F.array().cast("array<struct<start:int,end:int,match:string,before:string,after:string>>")
    return [F.when(n, F.filter(matches(text, p), k)).otherwise(none) for p, k, n in zip(BASE, keep, need)]


def written_form(kind: int, match: Column) -> Column:
    """How a candidate is written: marks of a mail address, issuer of a card, layout of a telephone number."""
    if kind == 0:
        return F.when(F.contains(match, F.lit("@")), 2).when(match.rlike(r"[(\[](?:at|dot)[)\]]"), 1).otherwise(0)
    if kind == 2:
        return _digits(match).rlike(ISSUERS).cast("int")
    return F.when(match.rlike(LAYOUTS[0]), 2).when(match.rlike(LAYOUTS[1]), 1).otherwise(0) if kind == 3 else F.lit(0)


def is_sound(kind: int, m: Column) -> Column:
    """The evidence of a candidate, which the trees do not see but for the length of a telephone number.

    An address parses once its marks are written out, eight groups make an IPv6 address (their colons are no feature), the
    digits of a card pass the check sum, and 8 to 15 digits after a plus are a telephone number. A telephone number
    without a plus has no evidence, which does not make it another number; ``fit_spans`` allows for that.
    """
    match, digits = m["match"], _digits(m["match"])
    if kind == EMAIL:
        plain = F.regexp_replace(F.regexp_replace(match, r" ?[(\[]at[)\]] ?| at | ?@ ?", "@"), r" ?[(\[]dot[)\]] ?| dot | ?\. ?", ".")
        return F.lower(plain).rlike(ADDRESS)
    if kind == IP:
        return F.length(match) - F.length(F.translate(match, ":", "")) == 7
    if kind == CARD:
        return luhn(digits)
    return F.endswith(m["before"], F.lit("+")) & F.length(digits).between(8, 15)


def candidates(text: Column) -> Column:
    """All spans of the generators as (kind, start, end) with the features of format and context and their label ``sound``."""

    def described(kind: int):
        def one(m: Column) -> Column:
            last = F.right(m["before"], F.lit(1))
            edge = lambda c: F.when((c == "") | c.rlike(r"[\s+]"), 0).when(c.rlike("[a-z0-9]"), 1).otherwise(2)
            hits = [m["before"].rlike(words) for words in CONTEXT]
            others = reduce(lambda a, b: a | b, [h for i, h in enumerate(hits) if i != kind])
            return F.struct(
                F.lit(kind).alias("kind"),
                m["start"].alias("start"),
                m["end"].alias("end"),
                F.least(F.length(_digits(m["match"])), F.lit(20)).alias("digits"),
                (F.lit(0) if kind == IP else F.least(F.length(F.regexp_replace(m["match"], "[A-Za-z0-9]", "")), F.lit(8))).alias("breaks"),
                m["match"].rlike("[A-Za-z]").cast("int").alias("letters"),
                F.when(hits[kind], 2).when(others, 1).otherwise(0).alias("context"),
                edge(last).alias("before"),
                edge(F.lower(m["after"])).alias("after"),
                written_form(kind, m["match"]).alias("form"),
                is_sound(kind, m).alias("sound"),
            )

        return one

    digits = text.rlike("[0-9][ ().-]{0,2}[0-9][ ().-]{0,2}[0-9]")
    spelled = F.contains(text, F.lit("@")) | text.rlike(r"\((?:at|dot)\)|\[(?:at|dot)\]| dot ")
    need = (spelled, F.contains(text, F.lit(":")), digits, digits)
    shape = "array<struct<kind:int,start:int,end:int,digits:int,breaks:int,letters:int,context:int,before:int,after:int,form:int,sound:boolean>>"
    none = F.array().cast(shape)
    return F.concat(*[F.when(n, F.transform(matches(text, p), described(k))).otherwise(none) for k, (p, n) in enumerate(zip(GENERATORS, need))])


@dataclass(frozen=True)
class Tree:
    """A leaf with a value, or a question ``feature <= cut`` with two trees."""

    value: float = 0.0
    feature: int = -1
    cut: int = 0
    low: "Tree | None" = None
    high: "Tree | None" = None

    def score(self, x: tuple[int, ...]) -> float:
        return self.value if self.feature < 0 else (self.low if x[self.feature] <= self.cut else self.high).score(x)

    def column(self, x: Column) -> Column:
        return F.lit(self.value) if self.feature < 0 else F.when(x[FEATURES[self.feature]] <= self.cut, self.low.column(x)).otherwise(self.high.column(x))


def grow(rows: list[tuple[tuple[int, ...], float, float]], depth: int, rate: float) -> Tree:
    """A tree on (features, gradient, curvature) that gains most at every split; leaves take a damped Newton step."""
    g, h = sum(r[1] for r in rows), sum(r[2] for r in rows)
    worth = lambda a, b: a * a / (b + 1.0)
    best = (1e-6, None)
    for f in range(len(FEATURES)) if depth else ():
        for cut in sorted({r[0][f] for r in rows})[:-1]:
            a, b = sum(r[1] for r in rows if r[0][f] <= cut), sum(r[2] for r in rows if r[0][f] <= cut)
            gain = worth(a, b) + worth(g - a, h - b) - worth(g, h)
            if gain > best[0]:
                best = (gain, (f, cut))
    if best[1] is None:
        return Tree(value=round(rate * g / (h + 1.0), 9))
    f, cut = best[1]
    sides = [[r for r in rows if (r[0][f] <= cut) == low] for low in (True, False)]
    return Tree(0.0, f, cut, grow(sides[0], depth - 1, rate), grow(sides[1], depth - 1, rate))


def boost(table: dict[tuple[int, ...], tuple[int, int]], rounds: int = 12, depth: int = 3, rate: float = 0.4) -> list[Tree]:
    """Gradient boosting of the logistic loss; ``table`` has the (positive, negative) counts of each feature combination."""
    trees, margin = [], dict.fromkeys(table, 0.0)
    for _ in range(rounds if table else 0):
        rows = []
        for x, (yes, no) in sorted(table.items()):
            p = 1 / (1 + math.exp(-margin[x]))
            rows.append((x, yes * (1 - p) - no * p, (yes + no) * p * (1 - p)))
        trees.append(grow(rows, depth, rate))
        margin = {x: m + trees[-1].score(x) for x, m in margin.items()}
    return trees


@dataclass(frozen=True)
class SpanModel:
    trees: list[Tree] = field(default_factory=list)
    thresholds: tuple[float, ...] = (math.inf,) * len(KINDS)

    def accepts(self, c: Column) -> Column:
        """Whether a candidate's margin reaches the threshold of its kind.

        A number as long as a card of the base pattern is settled there, by its check sum, and not taken up again.
        """
        possible = [k for k, t in enumerate(self.thresholds) if t < math.inf]
        if not possible:
            return F.lit(False)
        bar = reduce(lambda other, k: F.when(c["kind"] == k, F.lit(self.thresholds[k])).otherwise(other), possible, F.lit(math.inf))
        return (self.margin(c) >= bar) & ~settled(c)

    def margin(self, c: Column) -> Column:
        return reduce(lambda a, b: a + b, [t.column(c) for t in self.trees]) if self.trees else F.lit(0.0)


def settled(c: Column) -> Column:
    return (c["kind"] == 2) & (c["digits"] >= 16)


def threshold(levels: dict[float, tuple[int, int, int, int]], precision: float, support: int, least_share: float | None = None) -> float:
    """The lowest margin from which enough candidates are right; infinite without one.

    ``levels`` has for each margin the number with evidence, of all, and both among those no base span overlaps. With
    ``least_share`` evidence only shows a share of the right ones (learning from positive and unlabelled examples, Elkan
    and Noto 2008): the share is the mean rate of evidence among those that have it, and a margin's rate divided by
    it is the part that is right. Below ``least_share`` evidence says too little, and nothing is added.
    """
    sure = sum(yes for yes, *_ in levels.values())
    share = 1.0 if least_share is None else sum(yes * yes / n for yes, n, *_ in levels.values()) / max(sure, 1)
    bar, total, right, new, new_right = math.inf, 0, 0.0, 0, 0.0
    if share < (least_share or 0.0):
        return bar
    for margin in sorted(levels, reverse=True):
        yes, n, new_yes, new_n = levels[margin]
        part = min(1.0, yes / n / share) if share else 0.0
        total, right = total + n, right + n * part
        new, new_right = new + new_n, new_right + (new_yes if least_share is None else new_n * part)
        if total >= support and right >= precision * total and new_right >= precision * new:
            bar = margin
    return bar


def fit_spans(docs: DataFrame, precision: float = 0.95, support: int = 20, text: str = "text", doc_id: str = "doc_id", seed: int = 42, least_share: float = 0.3) -> SpanModel:
    """Boosted trees and thresholds from the candidates of all documents.

    A candidate is positive if ``is_sound`` says so. One half of the documents, by hash, trains the trees; on the other the
    lowest threshold of each kind is taken from which at least ``precision`` of the candidates, at least ``support`` of
    them, are right, and likewise of those that no base span overlaps, which are what is added. A kind without one
    adds no span. Telephone numbers are right by the estimate of ``threshold``, where at least ``least_share`` of them
    show a plus. The driver gets counts per combination of features, of which there are few.
    """
    draw = F.xxhash64(F.lit(seed), F.col(doc_id), whole_text(text))
    halved = docs.select(F.pmod(draw, F.lit(2)).alias("fold"), whole_text(text).alias("own_text"))
    found = halved.select("fold", F.array(*base_spans(F.col("own_text"))).alias("base"), candidates(F.col("own_text")).alias("spans")).where(F.size("spans") > 0)
    new = lambda s: ~settled(s) & ~F.exists(F.flatten("base"), lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    rows = found.select("fold", F.explode(F.transform("spans", lambda s: F.struct(*[s[f].alias(f) for f in FEATURES], s["sound"].alias("sound"), new(s).alias("new")))).alias("s")).select("fold", "s.*")
    sure = F.col("sound").cast("int")
    counts = rows.groupBy("fold", *FEATURES).agg(F.sum(sure).alias("yes"), F.count("*").alias("n"), F.sum(F.when(F.col("new"), sure).otherwise(0)).alias("new_yes"), F.sum(F.col("new").cast("int")).alias("new_n")).collect()
    halves: list[dict] = [{}, {}]
    for r in counts:
        halves[r.fold][tuple(r[f] for f in FEATURES)] = (r.yes, r.n, r.new_yes, r.new_n)
    trees = boost({x: (c[0], c[1] - c[0]) for x, c in halves[0].items()})
    thresholds = []
    for kind in range(len(KINDS)):
        levels: dict[float, tuple] = {}
        for x, c in halves[1].items():
            if x[0] == kind:
                margin = round(sum(t.score(x) for t in trees), 6)
                levels[margin] = tuple(a + b for a, b in zip(levels.get(margin, (0,) * 4), c))
        thresholds.append(threshold(levels, precision, support, least_share if kind == PHONE else None) - 1e-6)
    return SpanModel(trees, tuple(thresholds))


def with_spans(docs: DataFrame, model: SpanModel, text: str = "text") -> DataFrame:
    """``docs`` as column ``row`` with ``base`` and ``spans``: sorted arrays of (kind, start, end).

    ``spans`` has the base spans and the selected candidates that overlap none of them; of candidates that overlap each
    other, those with the higher margin stay, then the earlier ones. A null text has none. Nothing is exploded or
    shuffled: a row is worked on where it is.
    """
    own = F.col("own_text")
    plain = lambda kind: lambda m: F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end"))
    staged = docs.select(packed(docs).alias("row"), whole_text(text).alias("own_text"))
    base = F.concat(*[F.transform(spans, plain(k)) for k, spans in enumerate(base_spans(own))])
    added = F.transform(F.filter(candidates(own), model.accepts), lambda c: F.struct((-model.margin(c)).alias("rank"), c["start"].alias("start"), c["end"].alias("end"), c["kind"].alias("kind")))
    if all(t == math.inf for t in model.thresholds):
        added = F.array().cast("array<struct<rank:double,start:int,end:int,kind:int>>")
    found = staged.withColumn("found", F.struct(base.alias("base"), added.alias("added"))).select("row", F.col("found.base").alias("base"), F.col("found.added").alias("added"))

    overlaps = lambda spans, s: F.exists(spans, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    bare = lambda spans: F.transform(spans, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))

    def chosen(free: Column) -> Column:
        best = F.aggregate(F.sort_array(free), F.array().cast("array<struct<rank:double,start:int,end:int,kind:int>>"), lambda acc, s: F.when(overlaps(acc, s), acc).otherwise(F.concat(acc, F.array(s))))
        # Spans of one kind are apart from each other already.
        return F.when(F.size(F.array_distinct(F.transform(free, lambda s: s["kind"]))) > 1, best).otherwise(free)

    free = F.filter("added", lambda s: ~overlaps(F.col("base"), s))
    spans = F.when(F.size("added") > 0, F.sort_array(F.concat("base", bare(let(free, chosen))))).otherwise(F.sort_array("base"))
    return found.select("row", F.sort_array("base").alias("base"), spans.alias("spans"))


def span_text(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def find_personal_data(docs: DataFrame, model: SpanModel | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: (doc_id, base, spans). Repeated rows stay and an empty table gives no rows."""
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return with_spans(slim, model or fit_spans(slim)).select("row.doc_id", "base", "spans")


def redact(docs: DataFrame, model: SpanModel | None = None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with every span of the text replaced by its kind in angle brackets; overlapping spans are one.

    A null text stays null; other columns, clashing names included, are as they were.
    """
    model = model or fit_spans(docs, text=text, doc_id=doc_id)
    marked = with_spans(docs, model, text)
    own = F.col(f"row.{text}")
    names = F.array(*[F.lit(f"<{k}>") for k in KINDS])

    def replaced(order: Column) -> Column:
        step = lambda acc, s: F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(s["start"] >= acc["at"], F.concat(acc["parts"], F.array(F.substring(own, acc["at"] + 1, s["start"] - acc["at"]), F.get(names, s["kind"])))).otherwise(acc["parts"]).alias("parts"),
        )
        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))
        end = lambda acc: F.concat(F.array_join(acc["parts"], ""), F.substring(own, acc["at"] + 1, F.length(own)))
        return F.aggregate(order, zero, step, end)

    order = F.sort_array(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    clean = F.when(F.size("spans") > 0, let(order, replaced)).otherwise(own)
    return marked.select("row", clean.alias("clean")).select(*[(F.col("clean") if c == text else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
