"""Personal data: candidate spans by patterns, boosted trees over format and context, calibrated thresholds.

Everything on the executors is Spark SQL: candidates are arrays of spans, made and scored row by row without a shuffle.
Strict patterns (base spans: email, ip, card, phone) always stay. Wider generators propose more, which may overlap: addresses
with (at) and (dot), IPv6, phone numbers without a plus, card-like numbers that fail the check digit, and long keys and tokens
(secrets, which have no strict pattern). Boosted trees score
those by their format and what stands around them; a threshold for each kind, set for high precision on examples held back,
selects. What overlaps a base span or a better candidate goes.

There are no labelled spans to learn from, so the trees (a few, of depth two) are fitted when first used, on the driver, to a
few thousand made-up examples with a fixed seed, and become CASE expressions.
"""

from __future__ import annotations

import random
import re
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import documents_of

KINDS = ("email", "ip", "card", "phone")
#: Kinds of candidates.
WIDE_KINDS = (*KINDS, "secret")

#: Java patterns. Where a run of characters can't lead to a match from its first place it can't from any other, so a match
#: only begins where a run does or where the last match ended (\G); that and possessive repeats keep long runs linear.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    # 13 digits at least; shorter runs of digits fail the check of their number anyway
    "card": r"[0-9](?:[\x20-]?[0-9]){12,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
WIDER = {
    "email": r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]++ ?(?:\(at\)|\[at\]|\{at\}| at ) ?[a-z0-9-]++(?: ?(?:\(dot\)|\[dot\]|\{dot\}| dot |\.) ?[a-z0-9-]++)++",
    "ip": r"(?i)(?<![0-9a-f:])(?:[0-9a-f]{1,4}:){7}[0-9a-f]{1,4}(?![0-9a-f:])",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9]){12,18}+(?![0-9])",
    "phone": r"(?<![0-9+])(?:\([0-9]{2,4}\)|0?[0-9]{2,4})[\x20./-]{1,2}[0-9]{3,4}(?:[\x20.-][0-9]{3,4}){1,2}(?![0-9])",
    "secret": r"(?<![A-Za-z0-9_+/=-])(?=[A-Za-z_+/-]*+[0-9])[A-Za-z0-9_+/-]{20,}+",
}
#: A cheap sign that the wider pattern may match; without it the text isn't searched.
HINT = {"email": r"(?i)[(\[{ ]at[)\]} ]", "ip": r"(?i)[0-9a-f]:[0-9a-f]{1,4}:", "card": r"[0-9](?:[\x20-]?[0-9]){3}", "phone": r"[0-9][\x20.)/-]", "secret": r"[A-Za-z0-9_+/-]{20}"}
#: Words before a candidate that speak for it, by kind, in lower case.
CONTEXT = {
    "email": r"mail|contact|write|reach|address|correo|courriel|@",
    "ip": r"ip|host|server|addr|client|peer",
    "card": r"card|visa|master|amex|credit|debit|karte|carte|tarjeta|cc",
    "phone": r"tel|phone|call|fax|mobile|cell|handy|ruf|appel|llam|dial",
    "secret": r"token|secret|key|passw|auth|bearer|credential",
}
#: How many characters before a candidate count as its context.
REACH = 24
FEATURES = ("kind", "digits", "size", "signs", "context", "glued", "luhn", "lead", "variety", "marks")


# -- features, once in SQL for the data and once here for the examples the trees are fitted to ------------------------


def _features_sql(v: str, before: str, after: str, kind: str) -> dict[str, str]:
    digits = f"regexp_replace({v}, '[^0-9]', '')"
    return {
        "kind": str(WIDE_KINDS.index(kind)),
        "digits": f"length({digits})",
        "size": f"length({v})",
        "signs": f"length(regexp_replace({v}, '[^ ().:/-]', ''))",
        "context": f"IF(lower({before}) RLIKE '{CONTEXT[kind]}', 1, 0)",
        "glued": f"IF({before} RLIKE '[A-Za-z0-9_.-]$' OR {after} RLIKE '^[A-Za-z0-9_]', 1, 0)",
        "luhn": f"IF({_luhn_sql(digits)}, 1, 0)",
        "lead": f"coalesce(try_cast(substr({digits}, 1, 1) AS int), -1)",
        "variety": f"size(array_distinct(split({digits}, '')))",
        "marks": f"length(regexp_replace({v}, '[^(\\\\[{{]', ''))",
    }


def _luhn_sql(digits: str) -> str:
    d = f"coalesce(try_cast(substr(reverse({digits}), i, 1) AS int), 0)"
    return f"aggregate(sequence(1, greatest(length({digits}), 1)), 0, (a, i) -> a + IF(i % 2 = 1, {d}, IF({d} > 4, 2 * {d} - 9, 2 * {d}))) % 10 = 0"


def luhn(digits: str) -> bool:
    x = [int(c) for c in digits[::-1]]
    return sum(d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(x)) % 10 == 0


def _features(v: str, before: str, after: str, kind: str) -> list[float]:
    digits = re.sub("[^0-9]", "", v)
    return [
        WIDE_KINDS.index(kind),
        len(digits),
        len(v),
        len(re.sub(r"[^ ().:/-]", "", v)),
        bool(re.search(CONTEXT[kind], before.lower())),
        bool(re.search(r"[A-Za-z0-9_.-]$", before) or re.search(r"^[A-Za-z0-9_]", after)),
        luhn(digits) if digits else True,
        int(digits[0]) if digits else -1,
        len(set(digits)) if digits else 1,
        len(re.sub(r"[^(\[{]", "", v)),
    ]


# -- the trees -------------------------------------------------------------------------------------------------------


def _examples(rng: random.Random, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Made-up candidates of all kinds, with and without personal data: what people write, and what only looks like it."""

    def number(k: int) -> str:
        return "".join(rng.choice("0123456789") for _ in range(k))

    def word() -> str:
        return "".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randint(2, 8)))

    cue = {"email": ["e-mail: ", "contact ", "write to "], "ip": ["host ", "from ip ", "client addr "], "card": ["card number ", "Visa ", "credit card: "], "phone": ["tel. ", "call ", "Phone: ", "fax "], "secret": ['token = "', "api_key: ", "password=", "Authorization: Bearer ", "secret: "]}
    rows, labels = [], []
    for _ in range(n):
        kind, good = rng.choice(WIDE_KINDS), rng.random() < 0.5
        before = f"{word()} {word()} "
        after = rng.choice([" ", ".", ",", "\n"])
        if kind == "email":
            a, d = rng.choice([("(at)", "(dot)"), (" [at] ", " [dot] "), ("{at}", "."), (" at ", " dot ")]) if good else (" at ", rng.choice([".", ". "]))
            v = f"{word()}{a}{word()}{d}{rng.choice(['com', 'org', 'net']) if good else word()}"
        elif kind == "ip":
            v = ":".join("".join(rng.choice("0123456789abcdef") for _ in range(rng.randint(1, 4) if good else 2)) for _ in range(8))
        elif kind == "card":
            lead = rng.choice("3456") if good else rng.choice("0123456789")
            x = lead + number(15)
            v = " ".join(x[i : i + 4] for i in range(0, 16, 4)) if good and rng.random() < 0.6 else x if good or rng.random() < 0.6 else number(rng.randint(13, 19))
        elif kind == "secret":
            letters = rng.choice(["0123456789abcdef", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"])
            v = "".join(rng.choice(letters) for _ in range(rng.choice([24, 32, 40, 64])))
            if not good:  # a path, a name in parts, a number, or a digest that nothing calls a key
                v = rng.choice(["/".join(word() for _ in range(6)) + number(2), "_".join(word() for _ in range(6)) + number(1), number(rng.randint(20, 30)), v])
        elif good:
            v = rng.choice(["({}) {}-{}", "{}-{}-{}", "{}.{}.{}", "{} {} {}"]).format(rng.choice("23456789") + number(2), number(3), number(4))
        else:
            v = rng.choice([f"{rng.randint(1900, 2030)}-{number(4)}-{number(4)}", f"{number(3)} {number(3)} {number(3)}", f"{number(4)} {number(4)} {number(3)}", f"{number(2)}.{number(3)}.{number(3)}"])
        if rng.random() < (0.85 if good else 0.08):
            before += rng.choice(cue[kind])
        if not good and rng.random() < 0.3:
            before, after = before + word(), word()
        rows.append(_features(v, before[-REACH:], after, kind))
        labels.append(good)
    return np.array(rows, float), np.array(labels, float)


def _fit_tree(x: np.ndarray, slope: np.ndarray, bend: np.ndarray, depth: int):
    """A regression tree for one step of boosting: (feature, bound, less, not less) or a leaf's value."""
    g, h = slope.sum(), bend.sum()
    best = (1e-6, None)
    if depth:
        for f in range(x.shape[1]):
            for bound in np.unique(x[:, f])[1:]:
                less = x[:, f] < bound
                gl, hl = slope[less].sum(), bend[less].sum()
                gain = gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g**2 / (h + 1)
                if gain > best[0]:
                    best = (gain, (f, float(bound), less))
    if best[1] is None:
        return float(g / (h + 1))
    f, bound, less = best[1]
    return f, bound, _fit_tree(x[less], slope[less], bend[less], depth - 1), _fit_tree(x[~less], slope[~less], bend[~less], depth - 1)


def _value(tree, x: np.ndarray) -> np.ndarray:
    if isinstance(tree, float):
        return np.full(len(x), tree)
    f, bound, a, b = tree
    return np.where(x[:, f] < bound, _value(a, x), _value(b, x))


@cache
def model(trees: int = 25, rate: float = 0.4, examples: int = 3000, precision: float = 0.97) -> tuple[tuple, tuple[float, ...]]:
    """The trees (their values already damped), and for each kind the lowest threshold with such a precision on the half of
    the examples that they were not fitted to; where none has, one that nothing passes."""
    x, y = _examples(random.Random(11), examples)
    half = len(x) // 2
    z, out = np.zeros(half), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        t = _fit_tree(x[:half], y[:half] - p, p * (1 - p), 2)
        out.append(t)
        z += rate * _value(t, x[:half])
    z = rate * sum(_value(t, x[half:]) for t in out)
    bounds = []
    for k in range(len(WIDE_KINDS)):
        mine = x[half:, 0] == k
        s, right = z[mine], y[half:][mine]
        bounds.append(min((float(b) for b in np.unique(s) if right[s >= b].mean() >= precision), default=1e9))
    return tuple((rate, t) for t in out), tuple(bounds)


def _tree_sql(tree, rate: float, c: str) -> str:
    if isinstance(tree, float):
        return f"{rate * tree:.6f}D"
    f, bound, a, b = tree
    return f"IF({c}.{FEATURES[f]} < {bound:g}, {_tree_sql(a, rate, c)}, {_tree_sql(b, rate, c)})"


# -- spans -----------------------------------------------------------------------------------------------------------


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _spans(pattern: str, hint: str | None = None) -> Column:
    """Where the pattern matches in `text`, from left to right: array of struct(begin, stop, v), in code points."""
    p = _quoted(pattern)
    none = "cast(array() AS array<struct<begin:int,stop:int,v:string>>)"
    # a text is its matches and the pieces between them, in turn
    walk = (
        f"aggregate(zip_with(split(text, {p}, -1), regexp_extract_all(text, {p}, 0), (between, v) -> struct(between, v)), "
        f"struct(0 AS at, {none} AS found), "
        "(a, x) -> IF(x.v IS NULL, a, struct(a.at + length(x.between) + length(x.v) AS at, array_append(a.found, struct(a.at + length(x.between) AS begin, a.at + length(x.between) + length(x.v) AS stop, x.v AS v)) AS found)), "
        "a -> a.found)"
    )
    first = f"text RLIKE {_quoted(hint)} AND " if hint else ""
    return F.expr(f"IF({first}text RLIKE {p}, {walk}, {none})")


_DIGITS = "length(regexp_replace(x.v, '[^0-9]', ''))"
#: What a match must have besides; those without it are dropped.
_CHECKS = {
    "email": None,
    "ip": "forall(split(x.v, '[.]'), o -> o RLIKE '^0*([0-9]{1,2}|1[0-9][0-9]|2[0-4][0-9]|25[0-5])$')",
    "card": f"{_DIGITS} BETWEEN 13 AND 19 AND " + _luhn_sql("regexp_replace(x.v, '[^0-9]', '')"),
    "phone": f"{_DIGITS} BETWEEN 9 AND 15",
}


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document (`id_col`) with its base spans by kind and `added`, the candidates selected by the trees.

    email, ip, card, phone and added are arrays of struct(kind, begin, stop, score), in code points, stop exclusive, sorted
    by begin; score is null for base spans. `added` has spans of kind secret too. Null and empty texts have none. Rows without an id get no row, rows that repeat
    an id count as one document; other columns play no part. Equal candidates are one; of overlapping ones the best stays, the
    first of equals.
    """
    rows = documents_of(docs, id_col, text_col).withColumn("text", F.coalesce("text", F.lit("")))
    for kind in KINDS:
        check = f"filter(b_{kind}, x -> {_CHECKS[kind]})" if _CHECKS[kind] else f"b_{kind}"
        rows = rows.withColumn(f"b_{kind}", _spans(BASE[kind]))
        rows = rows.withColumn(f"b_{kind}", F.expr(f"transform({check}, x -> struct('{kind}' AS kind, x.begin AS begin, x.stop AS stop, cast(NULL AS double) AS score))"))
    for kind in WIDE_KINDS:
        rows = rows.withColumn(f"w_{kind}", _spans(WIDER[kind], HINT[kind]))
    base = "concat(" + ", ".join(f"b_{k}" for k in KINDS) + ")"
    trees, bounds = model()
    scored = []
    for k, kind in enumerate(WIDE_KINDS):
        features = _features_sql("x.v", f"substr(text, greatest(x.begin - {REACH}, 0) + 1, least(x.begin, {REACH}))", "substr(text, x.stop + 1, 1)", kind)
        free = f"filter(w_{kind}, x -> NOT exists({base}, b -> x.begin < b.stop AND b.begin < x.stop))"
        made = f"transform({free}, x -> struct('{kind}' AS name, x.begin AS begin, x.stop AS stop, {', '.join(f'{e} AS {n}' for n, e in features.items())}))"
        score = " + ".join(_tree_sql(t, rate, "c") for rate, t in trees)
        scored.append(f"filter(transform({made}, c -> struct(c.name AS kind, c.begin AS begin, c.stop AS stop, {score} AS score)), c -> c.score >= {bounds[k]:.6f}D)")
    rows = rows.withColumn("chosen", F.expr("concat(" + ", ".join(scored) + ")"))
    better = "(o.score > c.score OR (o.score = c.score AND o.begin < c.begin) OR (o.score = c.score AND o.begin = c.begin AND o.stop > c.stop))"
    added = f"filter(chosen, c -> NOT exists(chosen, o -> o.begin < c.stop AND c.begin < o.stop AND {better}))"
    return rows.select(F.col("doc").alias(id_col), *[F.col(f"b_{k}").alias(k) for k in KINDS], F.expr(added).alias("added"))


def redact(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with each span of `find_pii` replaced by its kind in angle brackets."""
    spans = found.select(F.col(id_col).alias("__id"), F.array_sort(F.transform(F.concat(*KINDS, "added"), lambda x: F.struct(x["begin"].alias("begin"), x["stop"].alias("stop"), x["kind"].alias("kind")))).alias("__spans"))
    both = docs.join(spans, docs[id_col] == spans["__id"], "left")
    # spans of several kinds may overlap: what is covered already is not written again
    walk = (
        f"aggregate(__spans, struct(0 AS at, '' AS t), (a, x) -> IF(x.stop <= a.at, a, struct(x.stop AS at, concat(a.t, substr({text_col}, a.at + 1, greatest(x.begin - a.at, 0)), '<', x.kind, '>') AS t)), "
        f"a -> concat(a.t, substr({text_col}, a.at + 1)))"
    )
    return both.withColumn(text_col, F.when(F.col(text_col).isNull() | (F.coalesce(F.size("__spans"), F.lit(0)) <= 0), F.col(text_col)).otherwise(F.expr(walk))).drop("__id", "__spans")
