"""Weak supervision of document quality with DataFrame operations only.

Rules look at a text's counts and vote good or bad, or abstain. Expectation-maximisation over the votes estimates how
often each rule votes what on good and on bad documents; a document's posterior probability of being good decides.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._scratch import Scratch

SPACES = " \t\n\x0b\f\r"
WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
ABSTAIN, GOOD, BAD = 0, 1, 2
#: A packed window key holds a position in so many low bits; longer texts, and those with
#: different windows that agree in the other bits, take the path that sorts pairs.
POSITION_BITS = 24


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body with value computed once: an expression in a lambda would be computed again for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeated_words(words: Column) -> Column:
    """How many of the words stand in a 3-word window that occurs twice or more, the first occurrence included.

    Window hashes are sorted with their positions, neighbours with equal hashes are repeats, and the repeats' positions,
    sorted, give the covered words: O(n log n) in the words of a text, without a shuffle.
    """
    low = (1 << POSITION_BITS) - 1
    index = lambda last: F.sequence(F.lit(0), last.cast("int"))

    def of_hashes(h: Column) -> Column:
        n = F.size(h)
        packed = F.transform(index(n - 1), lambda i: F.get(h, i).bitwiseAND(F.lit(~low)).bitwiseOR(i.cast("long")))
        pairs = F.transform(index(n - 1), lambda i: F.struct(F.get(h, i).alias("h"), i.cast("long").alias("i")))
        at_packed = let(F.sort_array(packed), lambda s: F.transform(s, lambda x: x.bitwiseAND(F.lit(low))))
        at_pairs = let(F.sort_array(pairs), lambda s: F.transform(s, lambda x: x["i"]))
        return let(F.when(n > low, at_pairs).otherwise(let(at_packed, lambda p: F.when(mixed(h, p), at_pairs).otherwise(p))), lambda p: of_positions(h, p))

    def mixed(h: Column, p: Column) -> Column:
        """Whether different hashes agree in their high bits, so that packed keys may part equal ones."""
        at = lambda i: F.get(h, F.get(p, i).cast("int"))
        return F.exists(index(F.size(p) - 2), lambda i: (at(i) != at(i + 1)) & (at(i).bitwiseAND(F.lit(~low)) == at(i + 1).bitwiseAND(F.lit(~low))))

    def of_positions(h: Column, p: Column) -> Column:
        same = lambda i, j: F.get(h, F.get(p, i).cast("int")) == F.get(h, F.get(p, j).cast("int"))
        repeats = F.filter(F.transform(index(F.size(p) - 1), lambda i: F.when(F.coalesce(same(i, i - 1), F.lit(False)) | F.coalesce(same(i, i + 1), F.lit(False)), F.get(p, i))), lambda x: x.isNotNull())
        return let(F.sort_array(repeats), covered)

    def covered(r: Column) -> Column:
        steps = F.transform(index(F.size(r) - 1), lambda i: F.least(F.lit(3).cast("long"), F.coalesce(F.get(r, i + 1) - F.get(r, i), F.lit(3).cast("long"))))
        return F.when(F.size(r) == 0, F.lit(0).cast("long")).otherwise(F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x))

    def of_words(h: Column) -> Column:
        windows = F.transform(index(F.size(h) - 3), lambda i: F.xxhash64(F.get(h, i), F.get(h, i + 1), F.get(h, i + 2)))
        return let(windows, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0).cast("long")).otherwise(of_hashes(w)))

    return F.when(F.size(words) < 3, F.lit(0).cast("long")).otherwise(let(F.transform(words, lambda w: F.xxhash64(w)), of_words))


def text_counts(docs: DataFrame) -> DataFrame:
    """doc_id and the counts that the rules read. A null text counts as empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    solid = F.translate(text, SPACES, "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    count = lambda x: x.cast("long")
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.length(solid).cast("long").alias("word_chars"),
        count(F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).alias("n_symbols"),
        let(words, lambda w: F.struct(count(F.size(w)).alias("n_words"), repeated_words(w).alias("n_repeat_words"))).alias("w"),
        let(lines, lambda x: F.struct(count(F.size(x)).alias("n_lines"), count(F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines"))).alias("l"),
        count(F.length(text) - F.length(F.translate(text, "!", ""))).alias("n_shouts"),
    ).select("doc_id", "w.n_words", "word_chars", "n_symbols", "l.n_dup_lines", "w.n_repeat_words", "l.n_lines", "n_shouts")


def vote(bad: Column | None = None, good: Column | None = None) -> Column:
    """BAD or GOOD where the condition holds, else ABSTAIN."""
    out = F.when(bad, F.lit(BAD)) if bad is not None else F
    return (out.when(good, F.lit(GOOD)) if good is not None else out).otherwise(F.lit(ABSTAIN))


def default_rules() -> dict[str, Column]:
    """Each rule's vote on a row of text_counts. A rule speaks of what it sees only: no fault of one kind is no evidence
    against a fault of another, so most rules vote bad or abstain, and one votes good on texts well inside every limit."""
    c = F.col
    words = F.greatest(c("n_words"), F.lit(1))
    plain = (c("n_symbols") * 20 < words) & (c("n_repeat_words") * 5 < 2 * words) & (c("n_shouts") * 10 < words) & (c("n_dup_lines") * 2 < F.greatest(c("n_lines"), F.lit(1)))
    return {
        "length": vote(bad=c("n_words") < 50),
        "word_length": vote(bad=(c("word_chars") > 10 * words) | (c("word_chars") < 3 * words), good=c("word_chars").between(F.lit(4) * words, F.lit(6) * words)),
        "symbols": vote(bad=c("n_symbols") * 10 > words),
        "repeats": vote(bad=c("n_repeat_words") * 2 > words),
        "lines": vote(bad=c("n_dup_lines") * 10 > c("n_lines") * 6),
        "shouts": vote(bad=c("n_shouts") * 5 > words),
        "plain": vote(good=plain),
    }


def label_model(patterns: DataFrame, rules: int, rounds: int = 30) -> DataFrame:
    """One row: prior (of good) and theta, the probability of each vote by rule and class.

    patterns has (votes array<int>, n): at most 3 ** rules rows, whatever the corpus. theta is flat, with index
    6 * rule + 3 * class + vote and class 0 good, 1 bad. Rounds start from rules that are right four times of five, and
    each count starts from one, so nothing is ever 0. An empty corpus leaves that start.
    """
    smooth = 1.0
    start = F.flatten(F.array_repeat(F.array(*[F.lit(x) for x in (0.2, 0.64, 0.16, 0.2, 0.16, 0.64)]), rules))
    rows = patterns.agg(F.sort_array(F.collect_list(F.struct("votes", "n"))).alias("p"))

    def score(model: Column, row: Column, cls: int) -> Column:
        prior = model["prior"] if cls == 0 else 1 - model["prior"]
        return F.aggregate(F.sequence(F.lit(0), F.lit(rules - 1)), F.log(prior), lambda a, j: a + F.log(F.get(model["theta"], j * 6 + 3 * cls + F.get(row["votes"], j))))

    def one_round(model: Column) -> Column:
        weighed = F.transform(F.col("p"), lambda r: F.struct(r["votes"].alias("votes"), r["n"].cast("double").alias("n"), (r["n"] / (1 + F.exp(F.least(F.lit(500.0), score(model, r, 1) - score(model, r, 0))))).alias("good")))
        return let(weighed, fitted)

    def fitted(w: Column) -> Column:
        zero = F.lit(0.0)
        total = F.aggregate(w, zero, lambda a, r: a + r["n"])
        good = F.aggregate(w, zero, lambda a, r: a + r["good"])
        in_class = lambda r, cls: F.when(cls == 0, r["good"]).otherwise(r["n"] - r["good"])

        def cell(k: Column, sums: Column) -> Column:
            rule, cls, v = F.floor(k / 6).cast("int"), F.floor(k % 6 / 3).cast("int"), k % 3
            mass = F.aggregate(w, zero, lambda a, r: a + F.when(F.get(r["votes"], rule) == v, in_class(r, cls)).otherwise(zero))
            return (mass + smooth) / (F.when(cls == 0, sums["good"]).otherwise(sums["total"] - sums["good"]) + 3 * smooth)

        return let(
            F.struct(total.alias("total"), good.alias("good")),
            lambda sums: F.struct(((sums["good"] + smooth) / (sums["total"] + 2 * smooth)).alias("prior"), F.transform(F.sequence(F.lit(0), F.lit(6 * rules - 1)), lambda k: cell(k, sums)).alias("theta")),
        )

    model = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.struct(F.lit(0.7).alias("prior"), start.alias("theta")), lambda m, _: one_round(m))
    return rows.select(model.alias("m")).select("m.prior", "m.theta")


def judged(counts: DataFrame, rules: dict[str, Column] | None = None, threshold: float = 0.5, rounds: int = 30) -> DataFrame:
    """counts with votes, posterior (probability of good), base_failed and kept."""
    rules = rules or default_rules()
    voted = counts.withColumn("votes", F.array(*rules.values()))
    model = label_model(voted.groupBy("votes").agg(F.count(F.lit(1)).alias("n")), len(rules), rounds)
    one = model.select(F.struct("prior", "theta")).scalar()
    step = lambda j, cls: F.log(F.get(one["theta"], j * 6 + 3 * cls + F.get(F.col("votes"), j)))
    odds = sum((step(j, 1) - step(j, 0) for j in range(len(rules))), F.log(1 - one["prior"]) - F.log(one["prior"]))
    posterior = 1 / (1 + F.exp(F.least(F.lit(500.0), odds)))
    base_failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = voted.withColumn("posterior", posterior).withColumn("base_failed", base_failed)
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= threshold))


def quality(docs: DataFrame, rules: dict[str, Column] | None = None, threshold: float = 0.5) -> DataFrame:
    """One row per document: doc_id, counts, votes, posterior, base_failed and kept.

    Texts are read once; their counts go to a scratch table from which votes and verdicts are made. A null text is an
    empty one and fails the base; repeated rows are judged alike; an empty table gives no rows; other columns of docs
    are ignored.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    return judged(scratch.save(text_counts(docs), "counts"), rules, threshold)
