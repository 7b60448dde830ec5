"""Personal data by candidate gradient boosting; built-in functions only.

1. Generators. Exact patterns give the base kinds (email, ip, card, phone); wide patterns
   give further candidates, which may overlap them: digit groups, written-out addresses,
   keys and assignments of secrets.
2. Every candidate has small integer features of its format (length, digits, letters,
   separators, changes, quotes) and of its neighbouring characters. The table of feature
   combinations and labels has at most COMBINATIONS rows, whatever the corpus, so it
   alone goes to the driver.
3. No labels of personal data exist, so evidence that no feature holds labels candidates:
   it overlaps a base span, is assigned to the name of a credential, follows words that
   name such data, or has the ending of an address; against it speak words for versions,
   licences and the like, a card's length without its checksum, and very many digits. Candidates without
   such evidence have no label. Boosted trees of depth two are fitted by logistic loss to
   the counts of labelled candidates in one half of the documents.
4. A threshold for each kind is the lowest score at which the other half's precision
   against the labels is at least PRECISION.
5. Trees and thresholds become CASE expressions, so scoring is part of the scan's plan;
   they decide on all candidates, with and without evidence.

Base spans always stay; a candidate that overlaps a base span adds nothing. Offsets are
code points, ends exclusive.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import STRIDE, cut, fold, scanned, table

# Possessive groups match as the greedy forms do here, in constant stack; the guard before a run
# of name characters lets only its first character, or the end of the last match, begin a match.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = list(BASE)
WIDE = {
    "number": r"(?<![A-Za-z0-9])(?:[(]?[0-9]++[)]?[\x20.-]?){2,8}(?<=[0-9])(?![A-Za-z0-9])",
    "contact": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?[(\[]at[)\]]\x20?[A-Za-z0-9-]{1,63}+(?:\x20?(?:[(\[]dot[)\]]|\.)\x20?[A-Za-z0-9-]{1,63}+){1,8}",
    "secret": r"(?<![A-Za-z0-9])(?:(?i:password|passwd|pwd|token|secret|api_?key)\x20?[=:]\x20?[\"']?[A-Za-z0-9+/_-]{8,}+[\"']?|[A-Z0-9]{16,}+(?![A-Za-z0-9])|[0-9a-f]{16,}+(?![A-Za-z0-9]))",
}
SPAN = "array<struct<start:int,rank:int,end:int,kind:string>>"
PRECISION = 0.95
ROUNDS, RATE = 40, 0.3
#: name and number of values of each feature; their product times kinds, labels and halves bounds the table of combinations
FEATURES = {"length": 5, "digits": 5, "letters": 3, "separators": 3, "changes": 3, "quoted": 2, "before": 4, "after": 4}
COMBINATIONS = math.prod(FEATURES.values()) * len(WIDE) * 2 * 2
NEAR = 24  # characters before a candidate that are searched for evidence
AGAINST = r"(?i)(?:version|licen[cs]e|v\.?|isbn|§|page|no\.)\s*$"
FOR = r"(?i)(?:phone|tel|fax|mobile|call|ssn|social|passport|account|iban|card|password|passwd|token|secret|key|contact|mail)\W{0,8}$"


def _luhn(number: Column) -> Column:
    """Whether the digits pass; number has at most 19 of them."""
    turned = F.reverse(number)
    digit = lambda i: F.substring(turned, i, F.lit(1)).cast("int")
    total = F.aggregate(
        F.sequence(F.lit(1), F.length(turned)),
        F.lit(0),
        lambda acc, i: acc + F.when(i % 2 == 1, digit(i)).when(digit(i) > 4, digit(i) * 2 - 9).otherwise(digit(i) * 2),
    )
    return total % 10 == 0


def _good(kind: str, m: Column) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == "ip":
        return m.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.|$)){4}$")
    if kind == "card":
        return F.when(F.length(digits).between(12, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _matches(text: Column, pattern: str) -> Column:
    """array<struct<start:int, m:string, before:string, after:string>> of a pattern's leftmost matches, none overlapping:
    a match starts after the gaps and matches before it; the NEAR characters before it, and the one after it where there is one."""
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    last = lambda c: F.substring(c, -NEAR, NEAR)

    def placed(both: Column) -> Column:
        rows = F.arrays_zip(both["found"].alias("m"), F.slice(both["gaps"], 1, F.size(both["found"])).alias("gap"), F.slice(both["gaps"], 2, F.size(both["found"])).alias("next"))
        zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("tail"))
        step = lambda state, x: F.struct((state["at"] + F.length(x["gap"]) + F.length(x["m"])).alias("at"), last(F.concat(state["tail"], x["gap"], x["m"])).alias("tail"))
        out = lambda state, x: F.struct((state["at"] + F.length(x["gap"])).alias("start"), x["m"].alias("m"), last(F.concat(state["tail"], x["gap"])).alias("before"), F.substring(x["next"], 1, 1).alias("after"))
        return F.transform(F.array(rows), lambda xs: scanned(xs, zero, step, out))[0]

    return F.transform(F.array(F.struct(found.alias("found"), gaps.alias("gaps"))), placed)[0]


_CHEAP = {"email": "@", "phone": "+", "ip": ".", "contact": None, "secret": None}


def _none() -> Column:
    return F.array().cast("array<struct<start:int,m:string,before:string,after:string>>")


def base_spans(text: Column) -> Column:
    """The base kinds' spans in order of start, then kind."""

    def spans(kind: str) -> Column:
        may = F.col("has_digit") if kind != "email" else F.lit(True)
        if kind in _CHEAP:
            may = may & F.contains(text, F.lit(_CHEAP[kind]))
        found = F.when(may, _matches(text, BASE[kind])).otherwise(_none())
        return F.transform(
            F.filter(found, lambda x: _good(kind, x["m"])),
            lambda x: F.struct(x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), (x["start"] + F.length(x["m"])).cast("int").alias("end"), F.lit(kind).alias("kind")),
        )

    return F.array_sort(F.concat(*(spans(k) for k in KINDS)))


def candidates(text: Column) -> Column:
    """array<struct<kind, start, end, features..., evidence>> of the wide generators; evidence: 1, 0 or null, the base spans not yet looked at."""

    def of(kind: str) -> Column:
        may = {"number": F.col("has_digit"), "contact": text.rlike(r"[(\[]at[)\]]"), "secret": F.col("has_digit") | text.rlike("[=:]")}[kind]
        found = F.when(may, _matches(text, WIDE[kind])).otherwise(_none())

        def features(x: Column) -> Column:
            m, before = x["m"], x["before"]
            value = F.regexp_replace(m, r"^[A-Za-z_]+\x20?[=:]\x20?", "") if kind == "secret" else m
            size, digits = F.length(value), F.regexp_replace(value, "[^0-9]", "")
            nd = F.length(digits)
            step = lambda c, *edges: sum((F.when(c >= e, 1).otherwise(0) for e in edges), F.lit(0))
            letters = F.length(F.regexp_replace(value, "[^A-Za-z]", ""))
            changes = F.size(F.split(value, "(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])"))
            side = lambda c: F.when(F.length(c) == 0, 0).when(c.rlike(r"^\s"), 1).when(c.rlike("^[A-Za-z0-9]"), 2).otherwise(3)
            card = (F.length(F.regexp_replace(value, r"[0-9\x20-]", "")) == 0) & nd.between(12, 19)
            if kind == "contact":
                evidence = F.when(before.rlike(AGAINST), 0).when(before.rlike(FOR) | value.rlike("[A-Za-z]$") & value.rlike(r"[^A-Za-z][A-Za-z]{2,4}$"), 1).otherwise(0)
            else:
                assigned = m.rlike("[=:]") if kind == "secret" else F.lit(False)
                evidence = F.when(before.rlike(AGAINST), 0).when(assigned | before.rlike(FOR), 1)
                evidence = evidence.when(F.when(card, ~_luhn(digits)).otherwise(False), 0)
                evidence = evidence.when(F.lit(kind == "number") & (nd > 19), 0)  # more than any such number has
            return F.struct(
                F.lit(kind).alias("kind"),
                x["start"].alias("start"),
                (x["start"] + F.length(m)).cast("int").alias("end"),
                step(size, 8, 12, 16, 24).alias("length"),
                step(nd, 1, 7, 9, 12).alias("digits"),
                step(letters, 1, 4).alias("letters"),
                step(F.length(F.regexp_replace(value, r"[^\x20().-]", "")), 1, 3).alias("separators"),
                step(changes, 3, 7).alias("changes"),
                value.rlike("[\"']").cast("int").alias("quoted"),
                side(F.substring(before, -1, 1)).alias("before"),
                side(x["after"]).alias("after"),
                evidence.cast("int").alias("evidence"),
            )

        return F.transform(found, features)

    return F.concat(*(of(k) for k in WIDE))


def met(base: Column, wide: Column) -> Column:
    """wide with whether each candidate overlaps a base span: one scan of both in order of start, and one back."""
    typed = F.transform(wide, lambda c: F.struct(c["start"].alias("start"), F.lit(1).alias("flag"), c["end"].alias("end"), c.alias("c")))
    spans = F.transform(base, lambda b: F.struct(b["start"].alias("start"), F.lit(0).alias("flag"), b["end"].alias("end"), F.get(wide, F.lit(-1)).alias("c")))
    forth = lambda xs: scanned(
        xs, F.lit(-1), lambda s, x: F.when(x["flag"] == 0, F.greatest(s, x["end"])).otherwise(s), lambda s, x: F.struct(x["start"].alias("start"), x["flag"].alias("flag"), x["end"].alias("end"), x["c"].alias("c"), (s > x["start"]).alias("hit"))
    )
    back = lambda xs: scanned(
        xs, F.lit(2**31 - 1), lambda s, x: F.when(x["flag"] == 0, x["start"]).otherwise(s), lambda s, x: F.struct(x["flag"].alias("flag"), x["c"].alias("c"), (x["hit"] | (s < x["end"])).alias("hit"))
    )
    both = F.transform(F.array(F.array_sort(F.concat(spans, typed))), lambda xs: F.transform(F.array(F.reverse(forth(xs))), back)[0])[0]
    alone = F.transform(wide, lambda c: F.struct(c.alias("c"), F.lit(False).alias("hit")))
    told = F.transform(F.filter(both, lambda x: x["flag"] == 1), lambda x: F.struct(x["c"].alias("c"), x["hit"].alias("hit")))
    return F.when((F.size(base) > 0) & (F.size(wide) > 0), told).otherwise(alone)


# --- boosted trees over feature combinations; all of this sees at most COMBINATIONS rows ---


def boost(rows: list[dict], rounds: int = ROUNDS, rate: float = RATE) -> tuple[float, list[tuple]]:
    """The log odds of label 1, and trees (feature, edge, (feature, edge, low, high), (feature, edge, low, high)): below the edge goes left."""
    if not rows:
        return 0.0, []
    names = [*FEATURES, "kind_no"]
    x = {f: np.array([r[f] for r in rows]) for f in names}
    n, y = (np.array([r[c] for r in rows], dtype=float) for c in ("n", "y"))
    odds = math.log(((n * y).sum() + 0.5) / ((n * (1 - y)).sum() + 0.5))
    score, trees = np.full(len(rows), odds), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        g, h = n * (y - p), n * np.maximum(p * (1 - p), 1e-6)

        def best(at: np.ndarray) -> tuple | None:
            top = None
            for f in names:
                v = x[f][at]
                sums = [np.bincount(v, weights=w[at]).cumsum() for w in (g, h)]  # noqa: B023
                for e in np.unique(v)[1:].tolist():
                    low = [c[e - 1] for c in sums]
                    sides = [low, [c[-1] - z for c, z in zip(sums, low, strict=True)]]
                    gain = sum(a * a / (b + 1.0) for a, b in sides)
                    if top is None or gain > top[0] + 1e-9:
                        top = (gain, f, e, *(float(rate * a / (b + 1.0)) for a, b in sides))
            return top[1:] if top else None

        root = best(np.arange(len(rows)))
        if root is None:
            return odds, trees
        f, e, low, high = root
        left, right = np.flatnonzero(x[f] < e), np.flatnonzero(x[f] >= e)
        tree = (f, e, best(left) or (f, e, low, low), best(right) or (f, e, high, high))
        trees.append(tree)
        score += np.array([leaf(tree, r) for r in rows])
    return odds, trees


def leaf(tree: tuple, r: dict) -> float:
    side = tree[3] if r[tree[0]] >= tree[1] else tree[2]
    return side[3] if r[side[0]] >= side[1] else side[2]


def thresholds(model: tuple[float, list[tuple]], rows: list[dict], precision: float = PRECISION) -> dict[str, float]:
    """For each kind how low a positive score may be for its precision, on rows held out from fitting, to suffice:
    down to halfway to the next lower score there. Where none does, no candidate passes."""
    out = {}
    for kind in WIDE:
        best, good, seen = math.inf, 0, 0
        scored = sorted(((model[0] + sum(leaf(t, r) for t in model[1]), r["n"], r["y"]) for r in rows if r["kind"] == kind), reverse=True)
        scored = [(s, sum(n for t, n, _ in scored if t == s), sum(n * y for t, n, y in scored if t == s)) for s in sorted({x[0] for x in scored}, reverse=True)]
        for k, (s, n, y) in enumerate(scored):
            good, seen = good + y, seen + n
            below = scored[k + 1][0] if k + 1 < len(scored) else 0.0
            if s > 0 and good >= precision * seen and below < s:
                best = (s + max(below, 0.0)) / 2 if below > 0 else 1e-9
        out[kind] = best
    return out


def margin(model: tuple[float, list[tuple]], c: Column) -> Column:
    """The trees' sum for candidate c, as CASE expressions."""
    kind = sum((F.when(c["kind"] == k, i).otherwise(0) for i, k in enumerate(WIDE)), F.lit(0))
    value = lambda f: kind if f == "kind_no" else c[f]
    side = lambda s: F.when(value(s[0]) >= s[1], F.lit(float(s[3]))).otherwise(F.lit(float(s[2])))
    return sum((F.when(value(t[0]) >= t[1], side(t[3])).otherwise(side(t[2])) for t in model[1]), F.lit(model[0]))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", precision: float = PRECISION) -> DataFrame:
    """doc_id, text_hash, base (spans), spans (base and accepted candidates): array<struct<start, rank, end, kind>> each.

    One row for every row of docs, repeated ones too. A null text is empty and has none.
    A kind without labelled candidates is not accepted. An empty table gives no rows.
    Other columns are not read.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    docs = docs.withColumn("has_digit", F.col("text").rlike("[0-9]"))
    seen = cut(docs.select("doc_id", F.xxhash64("text").alias("text_hash"), base_spans(F.col("text")).alias("base"), candidates(F.col("text")).alias("wide")))
    seen = seen.withColumn("wide", met(F.col("base"), F.col("wide")))
    names = ["kind", *FEATURES]
    every = seen.select((fold(F.col("doc_id"), 2) == 0).alias("fit"), F.explode("wide").alias("x"))
    labelled = every.select("fit", *(F.col(f"x.c.{f}").alias(f) for f in names), F.when(F.col("x.hit"), 1).otherwise(F.col("x.c.evidence")).alias("y")).where(F.col("y").isNotNull())
    combos = labelled.groupBy("fit", "y", *names).count()
    rows = [r.asDict() for r in combos.orderBy("fit", "y", *names).collect()]  # at most COMBINATIONS
    for r in rows:
        r |= {"n": r.pop("count"), "kind_no": list(WIDE).index(r["kind"])}
    seen = seen.withColumn("wide", F.transform(F.filter("wide", lambda x: ~x["hit"]), lambda x: x["c"]))
    model = boost([r for r in rows if r["fit"]] or rows)
    held_out = {r["kind"] for r in rows if not r["fit"]}
    limits = thresholds(model, [r for r in rows if not r["fit"] or r["kind"] not in held_out], precision)
    passes = lambda c: F.lit(False) if not rows else margin(model, c) >= sum((F.when(c["kind"] == k, F.lit(float(min(v, 1e300)))).otherwise(0.0) for k, v in limits.items()), F.lit(0.0))
    more = F.transform(
        F.filter("wide", passes),
        lambda c: F.struct(c["start"].alias("start"), (F.lit(len(KINDS)) + sum((F.when(c["kind"] == k, i).otherwise(0) for i, k in enumerate(WIDE)), F.lit(0))).cast("int").alias("rank"), c["end"].alias("end"), c["kind"].alias("kind")),
    )
    return seen.select("doc_id", "text_hash", "base", F.array_sort(F.concat(F.col("base").cast(SPAN), more.cast(SPAN))).alias("spans"))


def written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redacted(text: Column, spans: Column) -> Column:
    """text with every span replaced by its kind in angle brackets; overlapping spans become one, named by the first.

    Pieces are cut out of a block's own stretch of text, so that a text of very many spans is not walked through for each.
    """

    def built(x: Column) -> Column:
        t, spans = x["t"], x["spans"]
        heads = scanned(spans, F.lit(0), lambda at, s: F.greatest(at, s["end"]), lambda at, s: F.struct(at.alias("from"), s["start"].alias("start"), s["kind"].alias("kind")))
        heads = F.filter(heads, lambda s: s["start"] >= s["from"])
        end = F.array_max(F.transform(spans, lambda s: s["end"]))

        def joined(heads: Column) -> Column:
            def block(b: Column) -> Column:
                def pieces(own: Column) -> Column:
                    begin = own[0]["from"]
                    stretch = F.substring(t, begin + 1, F.element_at(own, -1)["start"] - begin)
                    cut_out = lambda y: F.transform(y["own"], lambda s: F.concat(F.substring(y["t"], s["from"] - y["begin"] + 1, s["start"] - s["from"]), F.lit("<"), s["kind"], F.lit(">")))
                    return F.array_join(F.transform(F.array(F.struct(own.alias("own"), begin.alias("begin"), stretch.alias("t"))), cut_out)[0], "")

                return F.transform(F.array(F.slice(heads, b * STRIDE + 1, F.lit(STRIDE))), pieces)[0]

            return F.array_join(F.transform(F.sequence(F.lit(0), F.ceil(F.size(heads) / STRIDE).cast("int") - 1), block), "")

        return F.concat(F.transform(F.array(heads), joined)[0], F.substring(t, end + 1, F.lit(2**31 - 1)))

    return F.when(F.size(spans) > 0, F.transform(F.array(F.struct(text.alias("t"), spans.alias("spans"))), built)[0]).otherwise(text)


def op1_boosted_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *(count(k) for k in KINDS), F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


QUERIES = {"op1_boosted_candidates": op1_boosted_candidates}
SQL: dict[str, str] = {}
