"""Personal data by boosted trees over candidate spans, in DataFrame expressions only.

Four fixed patterns with their checks give the base spans (email, ip, card, phone);
these are always kept.  Beside them generators of high recall propose spans: any run of
seven or more digits with separators, once for each of the kinds ip, card and phone
(and again without a country code), and anything like ``name (at) host (dot) tld``.
Each proposal is described by small integers on its format (digits, groups, separators,
lead) and its context (neighbouring characters, cue words), and boosted trees, one
ensemble per kind, score it.  A span is added where the score reaches the threshold of
its kind; of the kinds that do, the one furthest above its threshold is taken.

No labels are needed: in a sample of documents a proposal is positive if a base span
of its kind covers most of it.  The trees never see the checks themselves, and emails
also enter with their mark hidden, so that they can accept what the patterns miss.
The sample is bounded (``SAMPLE_DOCS``); Spark counts its proposals by feature values,
and only that count table, bounded by the product of the feature sizes, reaches the
driver, which fits the trees.  A quarter of the sample's documents is held out: there
the scores are calibrated by isotonic regression, and a kind's threshold is the least
score whose calibrated precision is at least ``PRECISION``.  A kind without positives
adds nothing.

Texts are scanned where they are: no shuffle, nothing is cut.  Patterns are possessive
and anchored to the start of a run, so a scan is linear in the text.  Proposals are
sought in the text with the base spans blanked out.  Null texts are read as empty;
repeated rows give repeated results; an empty table gives an empty result.  Other
columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlake.llm.common import let

KINDS = ("email", "ip", "card", "phone")
#: Documents that the trees learn from, at most (in expectation).
SAMPLE_DOCS = 20_000
#: Calibrated precision that an added span needs.
PRECISION = 0.9
#: Trees of a kind, their depth, learning rate and ridge.
TREES, DEPTH, RATE, RIDGE = 12, 3, 0.4, 1.0
#: Characters of context that cue words are sought in.
CONTEXT = 24

# The base patterns, written so that they start at the start of a run only.
_LOCAL = "[A-Za-z0-9._%+-]"
BASE = {
    "email": f"(?:\\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++",
    "ip": "(?<![0-9])[0-9]++\\.[0-9]++\\.[0-9]++\\.[0-9]++",
    "card": "(?<![0-9])[0-9](?:[\\x20-]?[0-9])++",
    "phone": "\\+[0-9][\\x20().0-9-]+[0-9]",
}
_NEEDS = {"email": "@", "ip": "[0-9]\\.[0-9]", "card": "[0-9][\\x20-]?[0-9]", "phone": "\\+[0-9]"}
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"

# The generators.
_NAME = "[\\p{L}\\p{N}._%+-]"
_AT, _DOT = "(?:@|[(\\[]at[)\\]])", "(?:\\.|[(\\[]dot[)\\]])"
MAIL_LIKE = f"(?:\\G|(?<!{_NAME})){_NAME}++\\x20?{_AT}\\x20?[\\p{{L}}\\p{{N}}-]++(?:\\x20?{_DOT}[\\p{{L}}\\p{{N}}-]++|\\x20{_DOT}\\x20[\\p{{L}}\\p{{N}}-]++)++"
DIGIT_LIKE = "(?<![0-9])[+(]?[0-9](?:[\\x20().\\-/]{0,3}[0-9]){6,}+"

#: Cue words of each kind.
CUES = {
    "email": "mail|contact|write|reach|kontakt|correo|courriel",
    "ip": "\\bip\\b|host|server|address|login|adresse",
    "card": "card|visa|credit|payment|karte|carte|tarjeta",
    "phone": "phone|tel|call|fax|mobile|cell|telefon|llama",
}
#: Features, and how many values each has.
FEATURES = {"size": 10, "lead": 3, "groups": 7, "mark": 6, "longest": 5, "before": 5, "after": 5, "cue": 2}


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _holds(kind: str, match: Column) -> Column:
    """Whether a match of the base pattern passes its check."""
    if kind == "ip":
        return match.rlike(f"^(?:{_BYTE}\\.){{3}}{_BYTE}$")
    if kind == "card":
        return F.length(_digits(match)).between(16, 19) & F.call_function("luhn_check", _digits(match))
    if kind == "phone":
        return F.length(_digits(match)).between(8, 15)
    return F.lit(True)


def _matches(text: Column, pattern: str) -> Column:
    """array<struct<s, e, m, before, after>>: all matches with their code point offsets
    and the text between them.  Offsets are sums within blocks of 64 matches on sums of blocks."""

    def placed(f: Column) -> Column:
        sizes = F.transform(f.getField("m"), lambda m, i: F.length(m) + F.length(F.get(f.getField("g"), i)))

        def with_sizes(sizes: Column) -> Column:
            blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / 64).cast("int")), lambda b: F.aggregate(
                F.slice(sizes, b * 64 + 1, F.lit(64)), F.lit(0), lambda a, x: a + x))

            def with_blocks(blocks: Column) -> Column:
                starts = F.transform(blocks, lambda _, b: F.aggregate(F.slice(blocks, F.lit(1), b), F.lit(0), lambda a, x: a + x))

                def spans(starts: Column) -> Column:
                    def span(m: Column, i: Column) -> Column:
                        block = F.floor(i / 64).cast("int")
                        gap = F.get(f.getField("g"), i)
                        s = F.get(starts, block) + F.length(gap) + F.aggregate(
                            F.slice(sizes, block * 64 + 1, i - block * 64), F.lit(0), lambda a, x: a + x)
                        return F.struct(s.alias("s"), (s + F.length(m)).alias("e"), m.alias("m"), gap.alias("before"),
                                        F.get(f.getField("g"), i + 1).alias("after"))
                    return F.transform(f.getField("m"), span)

                return let(starts, spans)

            return let(blocks, with_blocks)

        return let(sizes, with_sizes)

    return let(F.struct(F.regexp_extract_all(text, F.lit(pattern), 0).alias("m"), F.split(text, pattern, -1).alias("g")),
               lambda f: F.when(F.size(f.getField("m")) > 0, placed(f)))


def base_spans(text: Column, kind: str) -> Column:
    """array<struct<s, e>> of the base spans of a kind."""
    found = F.filter(_matches(text, BASE[kind]), lambda x: _holds(kind, x.getField("m")))
    slim = F.transform(found, lambda x: F.struct(x.getField("s").alias("s"), x.getField("e").alias("e")))
    return F.coalesce(F.when(text.rlike(_NEEDS[kind]), slim), F.array().cast("array<struct<s:int,e:int>>"))


def _replaced(text: Column, pattern: str, keep: Callable[[Column], Column], put: Callable[[Column], Column]) -> Column:
    def joined(f: Column) -> Column:
        return F.array_join(F.transform(f.getField("g"), lambda g, i: let(F.get(f.getField("m"), i), lambda m: F.concat(
            g, F.when(m.isNull(), "").when(keep(m), put(m)).otherwise(m)))), "")

    return let(F.struct(F.regexp_extract_all(text, F.lit(pattern), 0).alias("m"), F.split(text, pattern, -1).alias("g")),
               lambda f: F.when(F.size(f.getField("m")) > 0, joined(f)).otherwise(text))


def _blanked(text: Column, put: Callable[[str, Column], Column] = lambda kind, m: F.repeat(F.lit("\0"), F.length(m))) -> Column:
    """The text with the base spans blanked out, kind after kind."""

    def without(kind: str) -> Callable[[Column], Column]:
        return lambda t: F.when(t.rlike(_NEEDS[kind]), _replaced(
            t, BASE[kind], lambda m: _holds(kind, m), lambda m: put(kind, m))).otherwise(t)

    for kind in KINDS:
        text = let(text, without(kind))
    return text


def _case(pairs: Iterable[tuple[Column, int]], other: int) -> Column:
    out = F
    for test, value in pairs:
        out = out.when(test, value)
    return out.otherwise(other)


def _neighbour(c: Column) -> Column:
    """Kind of a neighbouring character: none, letter, white space, punctuation, other."""
    return _case([(c == "", 0), (c.rlike("\\p{L}"), 1), (c.rlike("\\s"), 2), (c.rlike("[.,;:!?]"), 3)], 4)


def _context(x: Column, kind: str) -> list[Column]:
    near = F.lower(F.substring(x.getField("before"), -CONTEXT, CONTEXT))
    return [_neighbour(F.substring(x.getField("before"), -1, 1)).alias("before"),
            _neighbour(F.substring(x.getField("after"), 1, 1)).alias("after"),
            near.rlike(CUES[kind]).cast("int").alias("cue")]


def _digit_features(x: Column, m: Column, kind: str) -> Column:
    n = F.length(_digits(m))
    groups = F.filter(F.split(m, "[^0-9]+"), lambda g: g != "")
    longest = F.array_max(F.transform(groups, lambda g: F.length(g)))
    return F.struct(
        F.when((n > 7) & (n <= 12), n - 7).otherwise(_case([(n <= 7, 0), (n <= 15, 6), (n == 16, 7), (n <= 19, 8)], 9)).alias("size"),
        _case([(m.startswith("+"), 2), (m.startswith("("), 1)], 0).alias("lead"),
        F.least(F.size(groups), F.lit(6)).alias("groups"),
        _case([(m.contains("("), 3), (m.contains("/"), 5), (m.contains("-"), 2), (m.contains("."), 1), (m.contains(" "), 4)], 0).alias("mark"),
        _case([(longest <= 3, 0), (longest == 4, 1), (longest <= 8, 2), (longest <= 15, 3)], 4).alias("longest"),
        *_context(x, kind))


def _mail_features(x: Column, m: Column, marked: Column) -> Column:
    labels = F.split(F.regexp_replace(m, f"^.*?{_AT}", ""), f"\\x20?{_DOT}\\x20?")
    local = F.length(F.regexp_extract(m, f"^({_NAME}++)", 1))
    top = F.element_at(labels, -1)
    return F.struct(
        F.least(F.floor(local / 4), F.lit(9)).cast("int").alias("size"),
        F.when(marked & m.rlike("[^\\x20]@[^\\x20]"), 1).otherwise(0).alias("lead"),
        F.least(F.size(labels), F.lit(6)).alias("groups"),
        _case([(top.rlike("^[A-Za-z]{2,3}$"), 1), (top.rlike("^[A-Za-z]{4,}$"), 2), (top.rlike("[0-9]"), 3)], 0).alias("mark"),
        F.least(F.floor(F.length(F.get(labels, F.lit(0))) / 4), F.lit(4)).cast("int").alias("longest"),
        *_context(x, "email"))


Tree = float | tuple[str, int, "Tree", "Tree"]


def fit_trees(cells: list[tuple[dict[str, int], int, float]]) -> tuple[float, list[Tree]]:
    """Start score and trees of a logistic boosting over (features, label, weight) cells."""
    pos = sum(w for _, y, w in cells if y)
    neg = sum(w for _, y, w in cells if not y)
    start = math.log((pos + .5) / (neg + .5))
    scores, trees = [start] * len(cells), []

    def grown(rows: list[int], grads: list[tuple[float, float]], depth: int) -> Tree:
        g, h = sum(grads[i][0] for i in rows), sum(grads[i][1] for i in rows)
        leaf = RATE * g / (h + RIDGE)
        best, choice = 1e-6, None
        if depth:
            for name, values in FEATURES.items():
                sums = [[0.0, 0.0] for _ in range(values)]
                for i in rows:
                    cell = sums[min(cells[i][0][name], values - 1)]
                    cell[0] += grads[i][0]
                    cell[1] += grads[i][1]
                lg = lh = 0.0
                for cut in range(values - 1):
                    lg, lh = lg + sums[cut][0], lh + sums[cut][1]
                    gain = lg * lg / (lh + RIDGE) + (g - lg) ** 2 / (h - lh + RIDGE) - g * g / (h + RIDGE)
                    if gain > best + 1e-9:
                        best, choice = gain, (name, cut)
        if choice is None:
            return leaf
        name, cut = choice
        return (name, cut, grown([i for i in rows if cells[i][0][name] <= cut], grads, depth - 1),
                grown([i for i in rows if cells[i][0][name] > cut], grads, depth - 1))

    for _ in range(TREES):
        grads = []
        for (_, y, w), s in zip(cells, scores):
            p = 1 / (1 + math.exp(-s))
            grads.append((w * (y - p), w * p * (1 - p)))
        tree = grown(list(range(len(cells))), grads, DEPTH)
        trees.append(tree)
        scores = [s + tree_score(tree, x) for (x, _, _), s in zip(cells, scores)]
    return start, trees


def tree_score(tree: Tree, x: dict[str, int]) -> float:
    while isinstance(tree, tuple):
        tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
    return tree


def threshold(scored: list[tuple[float, int, float]], precision: float = PRECISION) -> float | None:
    """The least score whose isotonic precision over (score, label, weight) is enough."""
    at: dict[float, list[float]] = {}
    for score, y, w in scored:
        cell = at.setdefault(score, [0.0, 0.0])
        cell[0] += w * y
        cell[1] += w
    blocks: list[list[float]] = []  # positives, weight, least score; precision never falls
    for score in sorted(at):
        blocks.append([*at[score], score])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            p, w, _ = blocks.pop()
            blocks[-1][0] += p
            blocks[-1][1] += w
    return next((score for p, w, score in blocks if p >= precision * w), None)


Model = dict[str, tuple[float, list[Tree], float]]


def _proposals(text: Column) -> Column:
    """array<struct<kind, y, x>>: the proposals of a text for training, with labels."""

    def covered(kind: str, m: Column) -> Column:
        good = F.filter(F.regexp_extract_all(m, F.lit(BASE[kind]), 0), lambda b: _holds(kind, b))
        return (F.aggregate(good, F.lit(0), lambda a, b: a + F.length(b)) * 2 > F.length(m)).cast("int")

    def row(kind: str, y: Column, x: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), y.alias("y"), *[x.getField(f).cast("int").alias(f) for f in FEATURES])

    def digit(x: Column) -> Column:
        m = x.getField("m")
        rest = F.regexp_replace(m, "^\\+[0-9]+[^0-9(]*", "")
        out = [row(kind, covered(kind, m), _digit_features(x, m, kind)) for kind in KINDS[1:]]
        bare = row("phone", covered("phone", m), _digit_features(x, rest, "phone"))
        return F.concat(F.array(*out), F.when(m.startswith("+"), F.array(bare)).otherwise(F.slice(F.array(bare), 1, 0)))

    def mail(x: Column) -> Column:
        m = x.getField("m")
        y = covered("email", m)
        return F.array(row("email", y, _mail_features(x, m, F.lit(True))), row("email", y, _mail_features(x, m, F.lit(False))))

    return F.concat(F.coalesce(F.flatten(F.transform(_matches(text, DIGIT_LIKE), digit)), F.array()),
                    F.coalesce(F.flatten(F.transform(_matches(text, MAIL_LIKE), mail)), F.array()))


def fit(df: DataFrame, text: str = "text", sample_docs: int = SAMPLE_DOCS, precision: float = PRECISION) -> Model:
    """Trees and thresholds of each kind, learnt from a bounded sample of the documents."""
    share = min(1.0, sample_docs / max(df.count(), 1))
    rows = df.select(F.col(text).alias("t")).filter(
        F.pmod(F.xxhash64("t", F.lit(12)), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)))).filter(F.col("t").rlike("[0-9@(\\[]"))
    rows = rows.select(F.explode(_proposals(F.col("t"))).alias("p"), (F.pmod(F.xxhash64("t", F.lit(13)), F.lit(4)) == 0).alias("held"))
    # at most one row per combination of feature values
    counted = rows.groupBy("p", "held").agg(F.count("*").alias("n")).collect()
    model: Model = {}
    for kind in KINDS:
        mine = [(r["p"].asDict(), r["held"], float(r["n"])) for r in counted if r["p"]["kind"] == kind]
        mine.sort(key=lambda c: (sorted(c[0].items(), key=lambda kv: kv[0]), c[1]))
        cells = [(x, x["y"], n) for x, held, n in mine if not held]
        if not any(y for _, y, _ in cells):
            continue
        start, trees = fit_trees(cells)
        scored = [(round(start + sum(tree_score(t, x) for t in trees), 9), x["y"], n) for x, held, n in mine if held]
        least = threshold(scored, precision)
        if least is not None:
            model[kind] = (start, trees, least)
    return model


def _score(x: Column, model: tuple[float, list[Tree], float]) -> Column:
    """How far the trees' sum lies above the threshold."""

    def column(tree: Tree) -> Column:
        if not isinstance(tree, tuple):
            return F.lit(float(tree))
        return F.when(x.getField(tree[0]) <= tree[1], column(tree[2])).otherwise(column(tree[3]))

    start, trees, least = model
    total = F.lit(start)
    for tree in trees:
        total = total + column(tree)
    return F.round(total, 9) - F.lit(least)


def added_spans(text: Column, model: Model) -> Column:
    """array<struct<kind, s, e>>: proposals outside of the base spans that the trees accept."""
    empty = F.array().cast("array<struct<kind:string,s:int,e:int>>")

    def picked(x: Column, offers: list[tuple[str, Column]]) -> Column:
        best = F.array_max(F.filter(F.array(*[F.struct(score.alias("over"), F.lit(-KINDS.index(kind)).alias("place"),
                                                       F.lit(kind).alias("kind")) for kind, score in offers]),
                                    lambda o: o.getField("over") >= 0))
        return let(best, lambda b: F.when(b.isNotNull(), F.struct(b.getField("kind").alias("kind"), x.getField("s").alias("s"),
                                                                  x.getField("e").alias("e"))))

    def scored(features: Column, kind: str) -> Column:
        return let(features, lambda f: _score(f, model[kind]))

    def digit(x: Column) -> Column:
        return picked(x, [(kind, scored(_digit_features(x, x.getField("m"), kind), kind)) for kind in KINDS[1:] if kind in model])

    def mail(x: Column) -> Column:
        return picked(x, [("email", scored(_mail_features(x, x.getField("m"), F.lit(True)), "email"))])

    def both(t: Column) -> Column:
        parts = [empty]
        if any(kind in model for kind in KINDS[1:]):
            parts.append(F.coalesce(F.when(t.rlike("[0-9]"), F.filter(F.transform(_matches(t, DIGIT_LIKE), digit), F.isnotnull)), empty))
        if "email" in model:
            parts.append(F.coalesce(F.when(t.rlike(_AT), F.filter(F.transform(_matches(t, MAIL_LIKE), mail), F.isnotnull)), empty))
        return F.concat(*parts)

    return let(_blanked(text), both)


def find(df: DataFrame, id_col: str = "doc_id", text: str = "text", model: Model | None = None) -> DataFrame:
    """Per row the id, the text, ``base`` and ``added``: the base spans of each kind (a struct of
    arrays) and the spans that the trees add."""
    model = fit(df, text) if model is None else model
    rows = df.select(F.col(id_col).alias(id_col), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    base = F.struct(*[base_spans(F.col("_text"), kind).alias(kind) for kind in KINDS])
    return rows.select(id_col, "_text", base.alias("base"), added_spans(F.col("_text"), model).alias("added"))


def _listed(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda x: F.concat_ws(":", F.lit(kind), x.getField("s").cast("string"), x.getField("e").cast("string")))


def digests(df: DataFrame, id_col: str = "doc_id", text: str = "text", model: Model | None = None) -> DataFrame:
    """Per row: id, base span counts, SHA-256 of the base spans, all spans by kind and start."""

    def row(f: Column) -> Column:
        base, added = f.getField("base"), f.getField("added")
        listed = F.concat(*[_listed(kind, base.getField(kind)) for kind in KINDS])

        def of(kind: str) -> Column:
            more = F.transform(F.filter(added, lambda x: x.getField("kind") == kind),
                               lambda x: F.struct(x.getField("s").alias("s"), x.getField("e").alias("e")))
            return F.array_sort(F.concat(base.getField(kind), more))

        every = F.concat(*[_listed(kind, of(kind)) for kind in KINDS])
        counts = [F.size(base.getField(kind)).cast("long").alias(f"n_{kind}") for kind in KINDS]
        return F.struct(*counts, F.sha2(F.array_join(listed, ","), 256).alias("base_sha256"), F.array_join(every, ",").alias("spans"))

    found = find(df, id_col, text, model)
    return found.select(id_col, let(F.struct("base", "added"), row).alias("r")).select(id_col, "r.*")


def redacted(df: DataFrame, id_col: str = "doc_id", text: str = "text", model: Model | None = None) -> DataFrame:
    """Per row the id and the text with base spans, kind after kind, and then the added
    spans replaced by ``[EMAIL]``, ``[IP]``, ``[CARD]`` and ``[PHONE]``."""
    model = fit(df, text) if model is None else model

    def replaced(f: Column) -> Column:
        blank, spans = f.getField("t"), F.array_sort(f.getField("spans"))
        # cut the blanked text before, between and behind the added spans
        return let(spans, lambda s: F.when(F.size(s) > 0, F.concat(F.array_join(F.transform(s, lambda x, i: F.concat(
            F.substring(blank, F.coalesce(F.get(s, i - 1).getField("e"), F.lit(0)) + 1,
                        F.greatest(x.getField("s") - F.coalesce(F.get(s, i - 1).getField("e"), F.lit(0)), F.lit(0))),
            F.lit("["), F.upper(x.getField("kind")), F.lit("]"))), ""),
            F.substring(blank, F.element_at(s, -1).getField("e") + 1, F.length(blank)))).otherwise(blank))

    def named(kind: str, m: Column) -> Column:
        return F.concat(F.lit("["), F.lit(kind.upper()), F.lit("]"))

    rows = df.select(F.col(id_col).alias(id_col), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    by_start = F.transform(added_spans(F.col("_text"), model), lambda x: F.struct(
        x.getField("s").alias("s"), x.getField("e").alias("e"), x.getField("kind").alias("kind")))
    once = let(F.struct(F.col("_text").alias("t"), by_start.alias("spans")), replaced)
    return rows.select(id_col, let(once, lambda t: _blanked(t, named)).alias("text"))
