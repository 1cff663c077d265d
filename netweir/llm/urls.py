"""URL filters: host and path rules, and gradient-boosted trees on lexical features (DataFrame functions only)."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, uniform

#: Fixed values: (host, path, verdict).
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
#: Trees are fitted on at most this many labelled URLs, drawn by hash.
TRAINING_ROWS = 20_000
#: A table of rules or of suffixes of at most this many rows is broadcast; a longer one is joined by shuffle.
BROADCAST_ROWS = 10_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parsed(pages: DataFrame, url: str = "url") -> DataFrame:
    """``pages`` with host and path; both empty for a null url or one without ``://``."""
    u = F.coalesce(F.col(url), F.lit(""))
    rest = F.when(F.instr(u, "://") > 0, F.regexp_replace(u, r"(?s)^.*?://", "")).otherwise("")
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    return pages.withColumns({"host": F.translate(host, UPPER, LOWER), "path": F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)})


def beside(small: DataFrame) -> DataFrame:
    """``small`` as the side of a join: broadcast after a count, never by a guess from the size of files."""
    return F.broadcast(small) if small.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else small.hint("merge")


def rules_table(spark, rules=RULES) -> DataFrame:
    return spark.createDataFrame([tuple(r) for r in rules], "rule_host string, rule_path string, rule_verdict string")


def ruled(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """host, path, rule, rule_verdict for every distinct (host, path): the longest rule that fits, or null.

    A rule fits its host and every subdomain if the path starts with the rule's.  A host has few suffixes, and
    each is looked up by equality; places are made distinct first, so a hot host is looked up once per path.
    """
    places = pages.select("host", "path").distinct()
    labels = F.split("host", r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    side = beside(rules)
    tried = places.withColumn("_suffix", F.explode(suffixes)).join(side, (F.col("_suffix") == F.col("rule_host")) & F.col("path").startswith(F.col("rule_path")))
    rule = F.concat("rule_host", "rule_path")
    best = tried.groupBy("host", "path").agg(F.max(F.struct(F.length(rule).alias("n"), rule.alias("rule"), F.col("rule_verdict"))).alias("_best"))
    return best.select("host", "path", "_best.rule", "_best.rule_verdict")


def lexical(url: Column, host: Column, path: Column) -> dict[str, Column]:
    """Features of the url's letters alone."""
    u = F.coalesce(url, F.lit(""))
    n = F.greatest(F.length(u), F.lit(1)).cast("double")
    share = lambda s, kept: F.length(F.regexp_replace(s, kept, "")) / F.greatest(F.length(s), F.lit(1))
    # a host's characters are named once, and each distinct one is counted by what is left without it
    size = F.greatest(F.length(host), F.lit(1)).cast("double")
    counts = F.transform(F.array(host), lambda h: F.transform(F.filter(F.array_distinct(F.split(h, "")), lambda c: c != ""), lambda c: (F.length(h) - F.length(F.replace(h, c, F.lit("")))) / size))
    entropy = F.aggregate(F.flatten(counts), F.lit(0.0), lambda a, p: a - p * F.log2(p))
    query = F.regexp_extract(u, r"(?s)\?([^#]*)", 1)
    return {
        "f_length": n,
        "f_host_length": F.length(host).cast("double"),
        "f_path_length": F.length(path).cast("double"),
        "f_depth": (F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))).cast("double"),
        "f_labels": F.size(F.split(host, r"\.", -1)).cast("double"),
        "f_digits": share(u, "[^0-9]"),
        "f_host_digits": share(host, "[^0-9]"),
        "f_hyphens": share(host, "[^-]"),
        "f_vowels": share(host, "[^aeiou]"),
        "f_entropy": entropy,
        "f_params": F.when(query == "", 0).otherwise(F.size(F.split(query, "&"))).cast("double"),
        "f_fragment": F.contains(u, F.lit("#")).cast("double"),
        "f_secure": F.startswith(u, F.lit("https")).cast("double"),
        "f_first_path": F.length(F.regexp_extract(path, r"^/([^/]*)", 1)).cast("double"),
    }


#: The last label and the last two labels of the host.
SUFFIXES = ("_tld", "_sld")
SUFFIX_FEATURES = tuple(f"f{k}_{what}" for k in SUFFIXES for what in ("rate", "seen"))
#: Hosts are dealt to so many folds; a row's suffix statistics come from the hosts of the others.
FOLDS = 4
#: A suffix has statistics once so many labelled rows have it.
LEAST_SEEN = 20


def suffix_keys(host: Column) -> dict[str, Column]:
    return {"_tld": F.substring_index(host, ".", -1), "_sld": F.substring_index(host, ".", -2)}


def fold(host: Column | str) -> Column:
    return F.pmod(F.xxhash64(F.lit(8), host), F.lit(FOLDS)).cast("int")


class UrlModel:
    """Suffix statistics and trees learned from labelled URLs."""

    def __init__(self, pipeline: PipelineModel | None, prior: float, stats: dict[str, DataFrame]):
        self.pipeline, self.prior, self.stats = pipeline, prior, stats

    def features(self, urls: DataFrame, learning: bool = False) -> DataFrame:
        """``urls`` (url, host, path, and for ``learning`` a rule_host) with the features.

        When learning, a row has the statistics of the other folds' hosts, and none of a suffix that holds the
        suffix its own label was decided by, which would only give the label away.
        """
        out = urls.withColumns({**lexical(F.col("url"), F.col("host"), F.col("path")), **suffix_keys(F.col("host")), "_fold": fold("host") if learning else F.lit(-1)})
        for k, t in self.stats.items():
            rate, seen = f"f{k}_rate", f"f{k}_seen"
            out = out.join(beside(t).withColumnRenamed("fold", "_fold"), [k, "_fold"], "left")
            told = F.concat(F.lit("."), k).endswith(F.concat(F.lit("."), "rule_host")) if learning else F.lit(False)
            known = F.col(rate).isNotNull() & ~F.coalesce(told, F.lit(False))
            out = out.withColumns({rate: F.when(known, F.col(rate)).otherwise(self.prior), seen: F.when(known, F.col(seen)).otherwise(0.0)})
        return out

    def blocked(self, urls: DataFrame) -> DataFrame:
        """``urls`` (url, host, path) with p_block, the probability that the URL should be blocked."""
        if self.pipeline is None:
            return urls.withColumn("p_block", F.lit(self.prior))
        from pyspark.ml.functions import vector_to_array

        scored = self.pipeline.transform(self.features(urls))
        return scored.select(*urls.columns, vector_to_array("probability")[1].alias("p_block"))

    def importances(self) -> dict[str, float]:
        if self.pipeline is None:
            return {}
        assembler, trees = self.pipeline.stages
        return dict(zip(assembler.getInputCols(), trees.featureImportances.toArray().tolist(), strict=True))


def train(labelled: DataFrame, rows: int = TRAINING_ROWS, trees: int = 12, depth: int = 4) -> UrlModel:
    """Fit on (url, host, path, blocked 0/1, and where a rule decided it its rule_host): suffix statistics over all
    rows, trees on at most ``rows`` distinct URLs, drawn by a hash of the url, so reruns agree.

    Without both labels the model is the constant share of label 1 (0.5 for no rows).
    """
    if "rule_host" not in labelled.columns:
        labelled = labelled.withColumn("rule_host", F.lit(None).cast("string"))
    n, ones, urls = labelled.agg(F.count("*"), F.sum("blocked"), F.approx_count_distinct("url")).first()
    prior = (ones or 0) / n if n else 0.5
    if not n or ones in (0, n):
        return UrlModel(None, float(prior), {})
    keyed = labelled.withColumns({**suffix_keys(F.col("host")), "_fold": fold("host")})
    stats = {}
    for k in SUFFIXES:
        own = keyed.groupBy(k, "_fold").agg(F.sum("blocked").alias("_ones"), F.count("*").alias("_n"))
        # the sums of all other folds, and of all for fold -1
        spread = own.withColumn("fold", F.explode(F.sequence(F.lit(-1), F.lit(FOLDS - 1)))).filter("fold <> _fold")
        t = spread.groupBy(k, "fold").agg(F.sum("_ones").alias("_ones"), F.sum("_n").alias("_n")).filter(F.col("_n") > LEAST_SEEN)
        stats[k] = durable(t.select(k, "fold", ((F.col("_ones") + 5 * prior) / (F.col("_n") + 5)).alias(f"f{k}_rate"), F.log1p(F.col("_n").cast("double")).alias(f"f{k}_seen")))
    model = UrlModel(None, float(prior), stats)
    likely = labelled.filter(uniform("url", seed=8) < min(1.0, 1.3 * rows / max(1, urls)))
    drawn = likely.groupBy("url", "host", "path").agg(F.max("blocked").alias("blocked"), F.max("rule_host").alias("rule_host")).orderBy(uniform("url", seed=8), "url").limit(rows)
    names = [*lexical(F.col("url"), F.col("host"), F.col("path")), *SUFFIX_FEATURES]
    data = durable(model.features(drawn, learning=True).select("blocked", *names))
    if data.select("blocked").distinct().count() < 2:
        return model
    stages = [VectorAssembler(inputCols=names, outputCol="features"), GBTClassifier(labelCol="blocked", featuresCol="features", maxIter=trees, maxDepth=depth, maxBins=32, stepSize=0.3, seed=8)]
    return UrlModel(Pipeline(stages=stages).fit(data), float(prior), stats)


def held_out(labelled: DataFrame) -> tuple[float, float]:
    """(accuracy, area under the curve) on the hosts of one fold of a model that has seen the other folds' hosts only.

    Rows are scored as they are when learning: without the suffix that decided them.
    """
    from pyspark.ml.evaluation import BinaryClassificationEvaluator

    model = train(labelled.filter(fold("host") > 0))
    test = labelled.filter(fold("host") == 0)
    if model.pipeline is None or test.isEmpty():
        return float("nan"), float("nan")
    scored = durable(model.pipeline.transform(model.features(test, learning=True)).select("blocked", "rawPrediction", "prediction"))
    accuracy = scored.agg(F.avg((F.col("blocked") == F.col("prediction")).cast("double"))).first()[0]
    return accuracy, BinaryClassificationEvaluator(labelCol="blocked").evaluate(scored)


def labelled_by_rules(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """url, host, path, blocked, rule_host of the rows of ``pages`` that a rule decides."""
    urls = parsed(pages.select("page_id", "url"))
    return _labels(urls.join(ruled(urls, rules).hint("merge"), ["host", "path"]))


def _labels(both: DataFrame) -> DataFrame:
    host = F.regexp_extract("rule", r"^([^/]*)", 1)
    return both.filter("rule IS NOT NULL").select("url", "host", "path", (F.col("rule_verdict") == "block").cast("int").alias("blocked"), host.alias("rule_host"))


def judge(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict, p_block for every page: the rule's verdict where one fits, else the trees'.

    The labelled URLs are those that a rule decides.  Null urls count as empty and are judged by the model;
    equal rows each get a row; an empty table gives an empty result.
    """
    urls = durable(parsed(pages.select("page_id", "url")))
    fitted = durable(ruled(urls, rules))
    # places grow with the pages: never a broadcast, and a place with many pages is split where they are merged
    both = urls.join(fitted.hint("merge"), ["host", "path"], "left")
    model = train(durable(_labels(both)))
    scored = model.blocked(both.select("page_id", "url", "host", "path", "rule", "rule_verdict"))
    verdict = F.coalesce("rule_verdict", F.when(F.col("p_block") >= 0.5, "block").otherwise("allow"))
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "p_block")
