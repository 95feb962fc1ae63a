"""Quality rules as a learned decision list.

One pass over the whole texts counts what rules can look at. On a bounded sample of labelled rows, sequential
covering grows one conjunction of thresholds after the other for the rows to reject (by information gain),
prunes it on rows held back, and takes its rows away, until what is left has no rule that is precise enough.
The list is emitted as one ordered Spark conditional expression: the first rule that holds decides.

The words of a lexicon feature are learned from the same sample: words whose texts are rejected nearly always.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestry.llm import store, texts

SAMPLE_ROWS = 10_000  # labelled rows that the rules are fitted on, at most
MIN_WORDS = 50
REPEAT_PERCENT = 50
LEXICON_WORDS = 500
STEMS = (4, 5)  # letters of the word beginnings that the lexicon may list
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_chars", "n_upper", "n_marks", "n_distinct", "n_lexicon")
FEATURES = {
    "words": "n_words",
    "mean_word": "word_chars / greatest(n_words, 1)",
    "symbol_share": "n_symbols / greatest(n_chars, 1)",
    "mark_share": "n_marks / greatest(n_chars, 1)",
    "upper_share": "n_upper / greatest(n_chars, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "distinct_share": "n_distinct / greatest(n_words, 1)",
    "lexicon_words": "n_lexicon",
    "lexicon_share": "n_lexicon / greatest(n_words, 1)",
}
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_MARK = np.zeros(256, bool)
_MARK[[ord(c) for c in "!?.,;:"]] = True


def _counted(member: np.ndarray, at: np.ndarray) -> np.ndarray:
    return texts.sums(member, at)


def _repeats(hashes: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Which items equal another one of their document, and which of these aren't the first."""
    order = np.lexsort((hashes, owner))
    h, o = hashes[order], owner[order]
    same = (h[1:] == h[:-1]) & (o[1:] == o[:-1])
    twice, later = np.zeros(len(h), bool), np.zeros(len(h), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    later[order[1:][same]] = True
    return twice, later


def measure(raw: np.ndarray, at: np.ndarray, lexicon: dict[int, np.ndarray]) -> dict[str, np.ndarray]:
    """The counts of each document of a block."""
    starts, ends, hashes, bounds = texts.words(raw, at, texts.SPACED_WORD)
    owner = texts.owners(bounds)
    made, first = texts.windows(hashes, bounds, 3)
    twice, _ = _repeats(made, owner[first])
    covered = np.zeros(len(hashes) + 2, bool)
    for j in range(3):
        covered[first[twice] + j] = True
    _, again = _repeats(hashes, owner)
    char = (raw & 0xC0) != 0x80
    line_starts, line_ends, line_bounds = texts.spans(raw != 10, at)  # lines of no bytes have no word either
    content = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(texts.SPACED_WORD[raw], out=content[1:])
    worded = content[line_ends] > content[line_starts]
    line_owner = texts.owners(line_bounds)[worded]
    _, dup = _repeats(texts.span_hashes(raw, line_starts[worded], line_ends[worded]), line_owner)
    n = len(at) - 1
    lowered = texts.LOWER[raw]
    plain_starts, plain_ends, plain, plain_bounds = texts.words(lowered, at, texts.ALNUM_WORD)
    listed = np.isin(plain, lexicon[0])
    for size in STEMS:
        long = np.flatnonzero(plain_ends - plain_starts >= size)
        stem = texts.span_hashes(lowered, plain_starts[long], plain_starts[long] + size)
        listed[long] |= np.isin(stem, lexicon[size])
    return {
        "n_words": np.diff(bounds),
        "word_chars": _counted(char & texts.SPACED_WORD[raw], at),
        "n_symbols": _counted(_SYMBOL[raw], at),
        "n_dup_lines": np.bincount(line_owner[dup], minlength=n),
        "n_repeat_words": texts.sums(covered[: len(hashes)], bounds),
        "n_lines": np.bincount(line_owner, minlength=n),
        "n_chars": _counted(char, at),
        "n_upper": _counted((raw >= 65) & (raw <= 90), at),
        "n_marks": _counted(_MARK[raw], at),
        "n_distinct": texts.sums(~again, bounds),
        "n_lexicon": texts.sums(listed, plain_bounds),
    }


def lexicon_hashes(lexicon: list[str]) -> dict[int, np.ndarray]:
    """Hashes of the whole words at 0, and of the stems (ending with ``*``) at their length."""

    def hashes(words: list[str]) -> np.ndarray:
        raw, at = texts.utf8(pa.array(words, pa.string()))
        return np.sort(texts.span_hashes(raw, at[:-1], at[1:]))

    whole = [w for w in lexicon if not w.endswith("*")]
    return {0: hashes(whole)} | {k: hashes([w[:-1] for w in lexicon if w.endswith("*") and len(w) == k + 1]) for k in STEMS}


def with_counts(documents: DataFrame, text_col: str = "text", lexicon: list[str] | None = None) -> DataFrame:
    """The documents with the counts above. Null reads as an empty text, of which all counts are 0."""
    spark = documents.sparkSession
    texts.small_batches(spark)
    kept = store.without(documents, *COUNTS)
    known = lexicon_hashes(lexicon or [])

    def run(batches):
        for batch in batches:
            table = pa.Table.from_batches([batch])
            for low, high, raw, at in texts.blocks(table[text_col]):
                part = table.slice(low, high - low)
                for name, values in measure(raw, at, known).items():
                    part = part.append_column(name, pa.array(values, pa.int64()))
                yield from part.to_batches()

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, *[T.StructField(c, T.LongType()) for c in COUNTS]]))


# ---------------------------------------------------------------- learning
@dataclass(frozen=True)
class Rule:
    """A conjunction of (feature, ``<=`` or ``>=``, threshold); the rows it covers are rejected."""

    tests: tuple[tuple[str, str, float], ...]
    covered: int
    precision: float

    def column(self) -> Column:
        out = F.lit(True)
        for name, sign, value in self.tests:
            feature = F.expr(FEATURES[name])
            out = out & (feature <= value if sign == "<=" else feature >= value)
        return out

    def rows(self, x: dict[str, np.ndarray]) -> np.ndarray:
        out = np.ones(len(next(iter(x.values()))), bool)
        for name, sign, value in self.tests:
            out &= x[name] <= value if sign == "<=" else x[name] >= value
        return out


def _best_test(x: dict[str, np.ndarray], y: np.ndarray, cuts: int = 64):
    """The threshold with the most information gain for the rows to reject."""
    p, n = y.sum(), (~y).sum()
    base = np.log2(p / (p + n))
    best = (0.0, None)
    for name, values in x.items():
        order = np.argsort(values, kind="stable")
        v, good = values[order], np.cumsum(y[order])
        at = np.flatnonzero(v[1:] > v[:-1]) + 1
        if len(at) > cuts:
            at = at[np.unique(np.linspace(0, len(at) - 1, cuts).astype(int))]
        for i in at:
            middle = float((v[i - 1] + v[i]) / 2)
            for sign, tp, size in (("<=", good[i - 1], i), (">=", p - good[i - 1], len(v) - i)):
                if tp:
                    gain = tp * (np.log2(tp / size) - base)
                    if gain > best[0] + 1e-9:
                        best = (gain, (name, sign, middle))
    return best[1]


def learn_rules(x: dict[str, np.ndarray], reject: np.ndarray, precision: float = 0.95, most_tests: int = 4, most_rules: int = 16, seed: int = 7) -> list[Rule]:
    """Sequential covering: grow on two thirds, prune on the rest, until no precise rule is found any more.

    Without rows of both kinds there is nothing to learn and the list is empty.
    """
    left = np.ones(len(reject), bool)
    rules: list[Rule] = []
    failed = 0
    grow = np.random.default_rng(seed).random(len(reject)) < 2 / 3
    while len(rules) < most_rules:
        g = left & grow
        if reject[g].sum() < 5 or reject[g].all():
            break
        tests: list[tuple[str, str, float]] = []
        inside = g.copy()
        while len(tests) < most_tests and reject[inside].any() and not reject[inside].all():
            test = _best_test({k: v[inside] for k, v in x.items()}, reject[inside])
            if test is None:
                break
            tests.append(test)
            inside &= Rule((test,), 0, 0).rows(x)
        held = left & ~grow
        worth = []
        for k in range(len(tests), 0, -1):  # the last tests go first
            covered = held & Rule(tuple(tests[:k]), 0, 0).rows(x)
            p, n = reject[covered].sum(), (~reject[covered]).sum()
            worth.append(((p - n) / max(p + n, 1), k, p, n))
        if not worth:
            break
        _, k, p, n = max(worth, key=lambda w: (w[0], w[2], -w[1]))
        rule = Rule(tuple(tests[:k]), 0, 0)
        covered = left & rule.rows(x)
        share = float(reject[covered].mean())
        sure = p > 0 and (p + 1) / (p + n + 2) >= precision - 2 / (p + n + 2)
        if not sure or share < precision:
            # No rule: its rows are set aside and others are tried, a few times.
            failed += 1
            if failed > 3:
                break
            grow = grow & ~covered
            continue
        rules.append(Rule(rule.tests, int(covered.sum()), share))
        left &= ~covered
    return rules


def decision(rules: list[Rule]) -> Column:
    """The ordered conditional: false at the first rule that holds, else true."""
    out = None
    for rule in rules:
        out = F.when(rule.column(), False) if out is None else out.when(rule.column(), False)
    return F.lit(True) if out is None else out.otherwise(True)


def _plain_words(text: Column) -> Column:
    lowered = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_distinct(F.split(lowered, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"))


def labelled_sample(documents: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """Texts of at most ``rows`` labelled documents, chosen by a hash of the id, with ``reject``:
    of low quality or toxic. Rows without id or quality are no examples."""
    chosen = labels.where("doc_id is not null and quality is not null").dropDuplicates(["doc_id"])
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    chosen = chosen.select("doc_id", ((F.col("quality") == 0) | (F.coalesce("toxic", F.lit(0)) == 1)).alias("reject"))
    return documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # ``rows`` bounds the broadcast


def learn_lexicon(sample: DataFrame, words: int = LEXICON_WORDS, share: float = 0.95) -> list[str]:
    """Words, and beginnings of words written as ``begin*``, whose texts are rejected nearly always, best first.

    An entry stands in so many different texts (equal ones count once) that, at the sample's rate of rejection,
    less than one entry in a hundred such lists would get in by chance.
    """
    each = sample.where("text is not null").groupBy(F.xxhash64("text")).agg(F.first("text").alias("text"), F.max("reject").alias("reject"))
    plain = _plain_words(F.col("text"))
    begins = lambda k: F.transform(F.filter("words", lambda w: w.rlike(f"^[a-z]{{{k}}}")), lambda w: F.concat(F.substring(w, 1, k), F.lit("*")))
    stems = [begins(k) for k in STEMS]
    entries = each.select("reject", plain.alias("words")).select("reject", F.explode(F.array_distinct(F.concat("words", *stems))).alias("word")).where("word <> ''")
    found = store.stored(entries.groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("reject").cast("int")).alias("bad")), "words")
    rate = each.agg(F.avg(F.col("reject").cast("int"))).first()[0]
    if not rate or rate == 1:
        return []
    least = max(5, int(np.ceil(np.log(0.01 / max(found.count(), 1)) / np.log(rate))))
    found = found.where((F.col("n") >= least) & (F.col("bad") >= share * F.col("n")))
    return [r.word for r in found.orderBy(F.desc("bad"), "word").limit(words).collect()]


@dataclass(frozen=True)
class Model:
    lexicon: tuple[str, ...]
    rules: tuple[Rule, ...]


def fit(documents: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """Lexicon and decision list from the labelled sample. Without labels both are empty: all is kept."""
    sample = store.stored(labelled_sample(documents, labels, rows), "sample")
    lexicon = learn_lexicon(sample)
    table = with_counts(sample, "text", lexicon).select("reject", *[F.expr(e).cast("double").alias(k) for k, e in FEATURES.items()]).toArrow()
    x = {k: table[k].to_numpy() for k in FEATURES}
    reject = table["reject"].to_numpy().astype(bool)
    order = np.lexsort([reject, *x.values()])  # whatever order the rows came in
    rules = learn_rules({k: v[order] for k, v in x.items()}, reject[order])
    store.dropped(documents.sparkSession, sample)
    return Model(tuple(lexicon), tuple(rules))


def judge(documents: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The documents with counts, ``base_failed`` (fewer than 50 words, or more than half of them in repeated
    three-word windows) and ``kept``: false if that failed, else what the decision list says.

    A null, empty or blank text has no words, so it fails. Long texts are counted whole. Equal rows get equal
    results; columns of the documents named like an output column give way to it.
    """
    out = with_counts(store.without(documents, "base_failed", "kept"), text_col, list(model.lexicon))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & decision(list(model.rules)))


def keep_good(documents: DataFrame, labels: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents that the rules keep, with their own columns only, whatever these are called."""
    plain = store.numbered_columns(documents)
    marked = judge(plain, fit(documents, labels), f"c{documents.columns.index(text_col)}")
    return marked.where("kept").select(*plain.columns).toDF(*documents.columns)


def op2_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(documents, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judge(documents, model).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
