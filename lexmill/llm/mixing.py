"""Mixing sources to target weights, with soft membership of domains.

A multinomial logistic regression over hashed words, fitted on labelled documents, predicts how far a
document belongs to each domain (``toxic``, else ``good`` or ``poor`` by quality). Rates x >= 0 are then
fitted by projected gradient so that the expected domain token totals, sum of tokens * posterior * rate,
match the targets in the least-squares sense, each domain's miss weighed by its own mass. In that metric
the step 1 is safe: the curvature matrix is similar to a stochastic one.

A round is one sum of K numbers over a small table (tokens, posteriors, rate); only these numbers reach
the driver. The table is written again every few rounds. The classifier is fitted on a bounded sample:
about ``SAMPLE`` labelled documents by a hash of the id, and of each domain ``LEAST`` where it has them, weighed so that
each domain counts by its labels. Prediction and sums cover all documents. Rounds end when every domain's share is met
within ``TOLERANCE`` of the largest target, or after ``ROUNDS``; ``miss`` says how far the worst share is then off, which
also shows targets that no rates can meet.

Null and empty texts have no tokens and the posteriors of an empty text; they keep the rate of their
posteriors. Rows of equal id are fitted each for itself. A label row that is null or repeated counts as
it stands. With labels of a single domain all posteriors are that domain's; with no labels they are
even. Domains of no mass cannot meet a target and are left out of the fit. An empty table gives an
empty result. Only the named columns are read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.llm._shared import saved

DOMAINS = ("poor", "good", "toxic")
#: Target shares of the tokens that the mixed corpus is to have, as many as the input has in all.
TARGETS = {"poor": 0.14, "good": 0.84, "toxic": 0.02}
SAMPLE, LEAST = 8000, 1000
FEATURES = 1 << 16
ROUNDS, UNROLLED, TOLERANCE = 48, 6, 1e-3


def domain_of(quality: Column, toxic: Column) -> Column:
    """The domain's number in DOMAINS; null labels count as not toxic, not good."""
    return F.when(toxic == 1, 2.0).when(quality == 1, 1.0).otherwise(0.0)


def _featured(docs: DataFrame, text: Column) -> DataFrame:
    words = F.filter(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    counted = docs.withColumn("_words", words)
    hashed = HashingTF(inputCol="_words", outputCol="_counts", numFeatures=FEATURES, binary=True).transform(counted)
    return Normalizer(inputCol="_counts", outputCol="_features").transform(hashed).drop("_counts")


def membership(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", sample: int = SAMPLE, least: int = LEAST) -> DataFrame:
    """Written rows (row, id, tokens, posteriors): one per document, row numbering them."""
    texts = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    known = labels.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("id"), domain_of(F.col("quality"), F.col("toxic")).alias("label"))
    counts = {int(r[0]): r[1] for r in known.groupBy("label").count().collect()}
    featured = _featured(texts.withColumn("row", F.monotonically_increasing_id()), F.col("text"))
    tokens = F.size("_words").cast("long").alias("tokens")
    even_chance = sample / max(sum(counts.values()), 1)
    chance = F.element_at(F.create_map(*[F.lit(x) for k, n in counts.items() for x in (float(k), min(1.0, max(even_chance, least / n)))]), F.col("label")) if counts else F.lit(0.0)
    chosen = known.withColumn("weight", 1 / chance).where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < chance * (1 << 30))
    # The chosen ids are about as many as the sample: they go to the texts, not the texts to them.
    train = _featured(texts.join(F.broadcast(chosen), "id"), F.col("text")).select("label", "weight", "_features")
    if len(counts) > 1:
        train = saved(train)
        seen = sorted(int(r[0]) for r in train.select("label").distinct().collect())
    else:
        seen = sorted(counts)
    if len(seen) > 1:
        # Domains without a label have no mass.
        model = LogisticRegression(featuresCol="_features", labelCol="label", weightCol="weight", probabilityCol="_p", family="multinomial", maxIter=25, regParam=2e-4).fit(train)
        p = vector_to_array(F.col("_p"))
        size = len(model.interceptVector)
        even = F.array(*[F.get(p, k) if k < size else F.lit(0.0) for k in range(len(DOMAINS))])
        scored = model.transform(featured)
    else:
        even = F.array(*[F.lit((1.0 if k in seen else 0.0) if seen else 1 / len(DOMAINS)) for k in range(len(DOMAINS))])
        scored = featured
    return saved(scored.select("row", "id", tokens, even.alias("posteriors")))


def fit_rates(members: DataFrame, targets: dict[str, float] | None = None, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """Adds ``rate`` to rows of (tokens, posteriors), and ``miss``: how far the worst domain's share is off, by the sums of the last round."""
    shares = [(targets or TARGETS).get(d, 0.0) for d in DOMAINS]
    mass = lambda rate: [F.sum(F.col("tokens") * F.get("posteriors", k) * rate) for k in range(len(DOMAINS))]
    first = members.agg(F.sum("tokens"), *mass(F.lit(1.0))).first()
    total = first[0] or 0
    own = [(x or 0.0) / total if total else 0.0 for x in first[1:]]
    rate = F.lit(1.0)
    state, sums = members.withColumn("rate", rate), own
    for number in range(rounds):
        miss = [s - t if m > 0 else 0.0 for s, t, m in zip(sums, shares, own, strict=True)]
        if not total or max(map(abs, miss)) <= tolerance * max(shares):
            break
        slope = reduce(lambda a, b: a + b, [F.get("posteriors", k) * F.lit(g / m) for k, (g, m) in enumerate(zip(miss, own, strict=True)) if m > 0])
        rate = F.greatest(F.lit(0.0), F.col("rate") - slope)
        state = state.withColumn("rate", rate)
        if number % UNROLLED == UNROLLED - 1:
            state = saved(state)
        sums = [(x or 0.0) / total for x in state.agg(*mass(F.col("rate"))).first()]
    miss = max((abs(s - t) for s, t, m in zip(sums, shares, own, strict=True) if m > 0), default=0.0)
    return state.withColumn("miss", F.lit(miss))


def copies_of(rate: Column, key: Column) -> Column:
    """How often a document is taken: its rate, rounded up or down by a hash of its key."""
    spot = F.pmod(F.xxhash64(key, F.lit("copies")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return (F.floor(rate) + (spot < rate - F.floor(rate)).cast("long")).cast("int")


def mixing_table(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", targets: dict[str, float] | None = None) -> DataFrame:
    """id, tokens, the posterior of every domain, rate, copies and miss."""
    fitted = fit_rates(membership(docs, labels, id_column, text_column), targets)
    return fitted.select(F.col("id").alias(id_column), "tokens", *[F.get("posteriors", k).alias(f"p_{d}") for k, d in enumerate(DOMAINS)], "rate", copies_of(F.col("rate"), F.col("id")).alias("copies"), "miss")


def mixed(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", targets: dict[str, float] | None = None) -> DataFrame:
    """The rows of docs, each as often as its copies say. Rows of equal id are taken alike."""
    rates = mixing_table(docs, labels, id_column, text_column, targets).groupBy(F.col(id_column).alias("_of")).agg(F.max("copies").alias("_copies"))
    packed = docs.select(F.struct("*").alias("_all"), F.col(id_column).alias("_id"))
    taken = packed.join(rates.where("_copies > 0"), F.col("_id").eqNullSafe(F.col("_of")))
    return taken.select("_all", F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("_copy")).select("_all.*")
