"""URL filter: host and path rules first, gradient-boosted trees for the URLs that no rule decides.

The rules' verdicts are the labels: URLs that a rule blocks or allows train the trees on lexical
features (lengths, depth, digit ratio, entropy, parameters) and on statistics of host suffixes. Those
count, over all URLs, how many end in a suffix and which part of the decided ones is blocked. A
bounded sample (``per_class`` of each verdict, in hash order) trains on the driver. The verdicts of a
URL's own host are left out of its statistics, in training and scoring alike, so that a column means the
same for hosts that rules decide and for those that they do not.

Rules are a list, which becomes one expression of the plan, or a table (host, path, verdict), which is
joined by the suffixes of the hosts and may be of any size.

Defined cases: a null url, or one without ``://``, has an empty host and path, no rule, and is judged
by the trees like any other; repeated rows are judged one by one; if the rules decide nothing, or all
alike, the trees' answer is the share of blocked URLs (0 if none); an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, prepare

#: (verdict, host, path). Fixed values of the contract.
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FEATURES = (
    "url_length", "host_length", "path_length", "depth", "digit_ratio", "entropy", "parameters", "labels",
    "hyphens", "host_digits", "fragment", "upper_ratio", "last_extension", "odd_ratio", "longest_part", "first_digit", "first_part",
)
SUFFIXES = 3  # of one to three labels


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.char_length(host) + 1), r"^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null if none does."""
    rule = verdict = None
    for v, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, h + p) if rule is None else rule.when(fits, h + p)
        verdict = F.when(fits, v) if verdict is None else verdict.when(fits, v)
    return (F.lit(None).cast("string"),) * 2 if rule is None else (rule, verdict)


def features(url: str | None, host: str, path: str) -> list[float]:
    url = url or ""
    n = max(1, len(url))
    query = url.partition("#")[0].partition("?")[2]
    counts = np.bincount(np.frombuffer(url.encode("utf-8", "replace"), np.uint8)) if url else np.zeros(1)
    p = counts[counts > 0] / max(1, counts.sum())
    parts = [x for x in path.split("/") if x]
    last = parts[-1] if parts else ""
    return [
        len(url), len(host), len(path), len(parts), sum(c.isdigit() for c in url) / n, float(-(p * np.log2(p)).sum()),
        query.count("&") + bool(query), host.count(".") + bool(host), host.count("-"), sum(c.isdigit() for c in host),
        "#" in url, sum(c.isupper() for c in url) / n, len(last.rpartition(".")[2]) if "." in last else 0,
        sum(not (c.isalnum() or c in "/.:-") for c in url) / n, max(map(len, parts), default=0),
        next((int(c) for c in path if c in "0123456789"), -1), len(parts[0]) if parts else 0,
    ]


def suffix(host: Column, labels: int) -> Column:
    return F.substring_index(host, ".", -labels)


class BoostedTrees:
    """Newton boosting of small trees on binned features, in numpy."""

    def __init__(self, trees=60, depth=3, rate=0.2, bins=32, l2=1.0):
        self.n, self.depth, self.rate, self.bins, self.l2 = trees, depth, rate, bins, l2
        self.bias, self.edges, self.trees = 0.0, [], []

    def _bin(self, x):
        return np.stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.edges)], 1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        rate = float(np.clip(y.mean() if len(y) else 0.0, 1e-3, 1 - 1e-3))
        self.bias = float(np.log(rate / (1 - rate)))
        if not len(y) or y.min() == y.max():
            self.edges = []
            return self
        cuts = np.linspace(0, 1, self.bins + 1)[1:-1]
        self.edges = [np.unique(np.quantile(x[:, j], cuts, method="nearest")) for j in range(x.shape[1])]
        b, f = self._bin(x), np.full(len(y), self.bias)
        width = max(len(e) for e in self.edges) + 1
        flat = b + np.arange(b.shape[1]) * width
        for _ in range(self.n):
            p = 1 / (1 + np.exp(-f))
            g, h = y - p, np.maximum(p * (1 - p), 1e-9)
            tree: dict[int, tuple] = {}
            node = np.zeros(len(y), np.int64)

            def grow(i, rows, depth, tree=tree, g=g, h=h, f=f):
                gs, hs = g[rows].sum(), h[rows].sum()
                best = None
                if depth and len(rows) >= 20:
                    k = flat[rows].ravel()
                    size = width * b.shape[1]
                    gl = np.bincount(k, np.repeat(g[rows], b.shape[1]), size).reshape(-1, width).cumsum(1)
                    hl = np.bincount(k, np.repeat(h[rows], b.shape[1]), size).reshape(-1, width).cumsum(1)
                    gain = gl**2 / (hl + self.l2) + (gs - gl) ** 2 / (hs - hl + self.l2) - gs**2 / (hs + self.l2)
                    j, c = divmod(int(gain.argmax()), width)
                    if gain[j, c] > 1e-6:
                        best = (j, c)
                if best is None:
                    step = self.rate * gs / (hs + self.l2)
                    tree[i] = (step,)
                    f[rows] += step
                    return
                left = b[rows, best[0]] <= best[1]
                tree[i] = best
                grow(2 * i + 1, rows[left], depth - 1)
                grow(2 * i + 2, rows[~left], depth - 1)

            grow(0, np.flatnonzero(node == 0), self.depth)
            self.trees.append(tree)
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        f = np.full(len(x), self.bias)
        if self.edges and len(x):
            b = self._bin(x)

            def walk(tree, i, rows):
                if len(tree[i]) == 1:
                    f[rows] += tree[i][0]
                    return
                left = b[rows, tree[i][0]] <= tree[i][1]
                walk(tree, 2 * i + 1, rows[left])
                walk(tree, 2 * i + 2, rows[~left])

            for tree in self.trees:
                walk(tree, 0, np.arange(len(x)))
        return 1 / (1 + np.exp(-f))


def rule_join(parsed: DataFrame, rules: DataFrame) -> DataFrame:
    """``parsed`` with rule and verdict from a table of rules (host, path, verdict), by the same choice.

    Each distinct host is joined by its suffixes to the rules, and its rules, as few as apply to one host,
    go to its rows; Spark broadcasts the tables or shuffles them, by size.
    """
    labels = F.split("host", r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    hosts = parsed.select("host").distinct().select("host", F.explode(ends).alias("_end"))
    given = rules.select(F.col("host").alias("_end"), F.col("path").alias("p"), F.col("verdict").alias("v"))
    length = -F.char_length(F.concat("_end", "p"))
    found = hosts.join(given, "_end").groupBy("host").agg(F.sort_array(F.collect_set(F.struct(length.alias("n"), F.col("v"), F.col("_end").alias("h"), F.col("p")))).alias("_fit"))
    first = F.filter("_fit", lambda x: F.startswith(F.col("path"), x.p))
    joined = parsed.join(found.withColumnRenamed("host", "_host"), F.col("host") == F.col("_host"), "left").withColumn("_r", F.get(first, F.lit(0)))
    return joined.withColumn("rule", F.concat("_r.h", "_r.p")).withColumn("verdict", F.col("_r.v")).drop("_host", "_fit", "_r")


def _parsed(pages: DataFrame, rules) -> DataFrame:
    host, path = split_url(F.col("url"))
    parsed = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    for k in range(1, SUFFIXES + 1):
        parsed = parsed.withColumn(f"s{k}", suffix(F.col("host"), k))
    if isinstance(rules, DataFrame):
        return rule_join(parsed, rules)
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return parsed.withColumn("rule", rule).withColumn("verdict", verdict)


def with_statistics(parsed: DataFrame) -> DataFrame:
    """Rows with, for each suffix length, n (URLs, log), d (decided ones that teach) and b (blocked among them).

    ``known`` is the verdict that a row may teach, or null.
    """
    rows = parsed
    for name, column in [("0", "host"), *((str(k), f"s{k}") for k in range(1, SUFFIXES + 1))]:
        counts = parsed.groupBy(F.col(column).alias(f"_s{name}")).agg(
            F.log1p(F.count(F.lit(1)).cast("double")).alias(f"n{name}"),
            F.count("known").cast("double").alias(f"d{name}"),
            F.count(F.when(F.col("known") == "block", 1)).cast("double").alias(f"b{name}"),
        )
        # a written table: Spark can then split a hot suffix in the join
        rows = rows.join(checkpoint(counts), F.col(column) == F.col(f"_s{name}"))
    return rows


def _inputs() -> list[Column]:
    """Suffix columns of the features: how many URLs, and the share of blocked ones on other hosts."""
    rate = lambda k: (F.col(f"b{k}") - F.col("b0") + 0.5) / (F.col(f"d{k}") - F.col("d0") + 1.0)
    return [c for k in range(1, SUFFIXES + 1) for c in (F.col(f"n{k}"), rate(k).alias(f"r{k}"))]


def _matrix(columns: list) -> np.ndarray:
    rows = zip(*(c.to_pylist() for c in columns), strict=True)
    return np.array([[float(v) for v in features(*r[:3])] + list(r[3:]) for r in rows], float).reshape(-1, len(FEATURES) + 2 * SUFFIXES)


def judge(pages: DataFrame, rules=RULES, per_class: int = 4000, threshold: float = 0.5, teaches: Column | None = None, **settings) -> DataFrame:
    """page_id, host, path, rule, verdict and the trees' score of each row.

    ``teaches``: a condition on host and path; other rows' rule verdicts are not learned from.
    """
    prepare(pages.sparkSession)
    known = F.col("verdict") if teaches is None else F.when(teaches, F.col("verdict"))
    rows = with_statistics(_parsed(pages, rules).withColumn("known", known))
    decided = rows.where("known is not null")
    order = [F.xxhash64("url"), F.col("url"), F.col("page_id")]
    sample = [decided.where(F.col("known") == v).orderBy(*order).limit(per_class) for v in ("allow", "block")]
    got = sample[0].unionByName(sample[1]).select("known", "url", "host", "path", *_inputs()).toArrow()
    x = _matrix(got.columns[1:])
    model = BoostedTrees(**settings).fit(x, np.array([v == "block" for v in got.column("known").to_pylist()], float))
    schema = f"page_id {pages.schema['page_id'].dataType.simpleString()}, host string, path string, rule string, verdict string, score double"

    def run(batches):
        for batch in batches:
            s = model.score(_matrix([batch.column(5), batch.column(1), batch.column(2), *batch.columns[6:]]))
            verdict = [v or ("block" if p >= threshold else "allow") for v, p in zip(batch.column(4).to_pylist(), s, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:4], pa.array(verdict, pa.string()), pa.array(s)],
                names=["page_id", "host", "path", "rule", "verdict", "score"],
            )

    return rows.select("page_id", "host", "path", "rule", "verdict", "url", *_inputs()).mapInArrow(run, schema)
