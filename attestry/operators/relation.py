"""Eight-way claim-evidence relation, conclusions and local answers."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import fields, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestry import lexicons as lx
from attestry.functions import text as tx
from attestry.lexicons import RelationLexicon

EDGE_MARKS = "。！？?；;，,"
TERM_SPLIT = r"[\s、，,。；;：:（）()《》“”\"']+"


def flat_text(text: Column) -> Column:
    """No white space, no sentence marks at the ends."""
    return F.trim(tx.remove_spaces(F.coalesce(text, F.lit(""))), F.lit(EDGE_MARKS))


def terms_of(claim: Column, lexicon: RelationLexicon = RelationLexicon()) -> Column:
    """Core terms of a claim and the known phrases inside them, distinct in order."""
    cleaned = tx.drop_all(flat_text(claim), lexicon.stop_words)
    raw = F.filter(F.split(cleaned, TERM_SPLIT), lambda t: F.length(t) >= 2)
    with_markers = F.transform(
        raw, lambda t: F.concat(F.array(t), F.filter(tx.strings(lexicon.claim_term), lambda m: F.contains(t, m)))
    )
    return F.array_distinct(F.flatten(with_markers))


def claim_terms(claims: DataFrame, lexicon: RelationLexicon = RelationLexicon()) -> DataFrame:
    rows = claims.select("claim_id", F.posexplode(terms_of(F.col("claim_text"), lexicon)).alias("p", "term"))
    return rows.select("claim_id", (F.col("p") + 1).alias("term_no"), "term")


def _with_overlap(pairs: DataFrame, lexicon: RelationLexicon) -> DataFrame:
    """Adds flat texts, terms, matched terms and the overlap flag to (claim, title, content) rows."""
    return (
        pairs.withColumn("flat_claim", flat_text(F.col("claim_text")))
        .withColumn("flat_evidence", flat_text(F.concat_ws("\n", F.coalesce("title", F.lit("")), F.coalesce("content", F.lit("")))))
        .withColumn("terms", terms_of(F.col("flat_claim"), lexicon))
        .withColumn("matched_terms", F.filter("terms", lambda t: F.contains(F.col("flat_evidence"), t)))
        .withColumn(
            "enough", (F.size("matched_terms") >= 2) | ((F.size("matched_terms") >= 1) & (F.size("terms") <= 2))
        )
    )


def term_overlap(pairs: DataFrame, lexicon: RelationLexicon = RelationLexicon()) -> DataFrame:
    return _with_overlap(pairs, lexicon).select(
        "claim_id", "evidence_id", F.size("terms").alias("term_count"), F.size("matched_terms").alias("matched_count"), "enough"
    )


def subject_effect(claim: Column, evidence: Column, lexicon: RelationLexicon) -> Column:
    """Whether some mention of the claim's subject is followed closely by an effect word."""
    window_ok = lambda w: tx.contains_any(w, lexicon.partial_effect) & ~tx.contains_any(w, lexicon.whole_words)
    found = F.lit(False)
    for subject in lexicon.single_item_subject:
        word = F.lit(subject)
        mentions = F.exists(
            tx.occurrences(evidence, word), lambda i: window_ok(F.substring(evidence, i, F.lit(36)))
        )
        found = found | (F.contains(claim, word) & F.contains(evidence, word) & mentions)
    return found


def subject_partial_support(pairs: DataFrame, lexicon: RelationLexicon = RelationLexicon()) -> DataFrame:
    rows = _with_overlap(pairs, lexicon)
    return rows.select(
        "claim_id", "evidence_id", subject_effect(F.col("flat_claim"), F.col("flat_evidence"), lexicon).alias("partial_support")
    )


def classify_relation(pairs: DataFrame, lexicon: RelationLexicon = RelationLexicon()) -> DataFrame:
    """Pairs with ``relation_type``, its label and the reason; first matching class wins."""
    rows = _with_overlap(pairs, lexicon)
    claim, text = F.col("flat_claim"), F.col("flat_evidence")
    has = lambda words: tx.contains_any(text, words)
    rows = (
        rows.withColumn("is_refute", has((*lexicon.refute, *lexicon.refute_phrases)))
        .withColumn("is_condition", has(lexicon.condition))
        .withColumn("is_support", has(lexicon.support))
        .withColumn("is_method", has(lexicon.method_context) & tx.contains_any(claim, lexicon.single_item_subject))
    )
    matched, terms, enough = F.size("matched_terms"), F.size("terms"), F.col("enough")
    kind = (
        F.when(text == "", "insufficient")
        .when(F.col("is_refute"), F.when(enough, "direct_refute").otherwise("context_only"))
        .when(has(lexicon.example), "example_only")
        .when(
            F.col("is_method"),
            F.when(subject_effect(claim, text, lexicon), "partial_support").otherwise("method_or_formula_context"),
        )
        .when(F.col("is_condition") & (~F.col("is_support") | enough), "risk_or_condition")
        .when(F.col("is_support") & enough, "direct_support")
        .when(
            matched > 0,
            F.when(matched < F.greatest(F.lit(2), F.floor(terms / 2)), "context_only").otherwise("partial_support"),
        )
        .otherwise("insufficient")
    )
    label = F.lit("")
    rows = rows.withColumn("relation_type", kind)
    for name, shown in lx.RELATION_LABELS.items():
        label = F.when(F.col("relation_type") == name, shown).otherwise(label)
    shown_terms = F.when(matched > 0, F.array_join(F.slice("matched_terms", 1, 4), "、")).otherwise("未覆盖核心词")
    return rows.withColumn("relation_label", label).select(
        *pairs.columns,
        "flat_claim",
        "relation_type",
        "relation_label",
        F.concat("relation_label", F.lit("；命中核心词："), shown_terms).alias("relation_reason"),
    )


def merge_marker_rules(base: RelationLexicon, override: Mapping[str, Iterable[str]]) -> RelationLexicon:
    """Lexicon with the override's markers appended, without duplicates."""
    known = {f.name for f in fields(base)}
    changes = {}
    for name, words in override.items():
        if name in known and isinstance(words, (list, tuple)):
            changes[name] = tuple(dict.fromkeys([*getattr(base, name), *[str(w) for w in words if str(w)]]))
    return replace(base, **changes)


def merge_marker_rows(base: DataFrame, override: DataFrame) -> DataFrame:
    """The same on (marker, words) rows: one row per marker, words appended in order."""
    return (
        base.select("marker", F.col("words").alias("b"))
        .join(override.select("marker", F.col("words").alias("o")), "marker", "full_outer")
        .select(
            "marker",
            tx.non_empty(
                F.array_union(F.coalesce("b", F.array().cast("array<string>")), F.coalesce("o", F.array().cast("array<string>")))
            ).alias("words"),
        )
    )


CONCLUSION_ORDER = ("direct_refute", "direct_support", "partial_support", "method_or_formula_context", "example_only", "risk_or_condition")


def conclusion_class(kinds: Column) -> Column:
    limits = F.array_contains(kinds, "risk_or_condition") | F.array_contains(kinds, "partial_support")
    expr = F.when(F.array_contains(kinds, "direct_refute"), "direct_refute").when(
        F.array_contains(kinds, "direct_support"),
        F.when(limits, "direct_support_with_limits").otherwise("direct_support"),
    )
    for name in CONCLUSION_ORDER[2:]:
        expr = expr.when(F.array_contains(kinds, name), name)
    return expr.otherwise("insufficient")


def conclusion_text(kind: Column, claim: Column, texts: Mapping[str, str] = lx.CONCLUSIONS) -> Column:
    """Template of the class with the claim filled in; unknown classes get the default one."""
    template = F.lit(texts.get("insufficient", lx.CONCLUSIONS["insufficient"]))
    for name in lx.CONCLUSIONS:
        template = F.when(kind == name, texts.get(name, lx.CONCLUSIONS[name])).otherwise(template)
    return F.replace(template, F.lit("{claim}"), claim)


def infer_conclusion(relations: DataFrame, claims: DataFrame, texts: Mapping[str, str] = lx.CONCLUSIONS) -> DataFrame:
    """(claim_id, conclusion_class, conclusion); a claim without evidence is insufficient."""
    kinds = relations.groupBy("claim_id").agg(F.collect_set("relation_type").alias("kinds"))
    rows = claims.select("claim_id", flat_text(F.col("claim_text")).alias("flat")).join(kinds, "claim_id", "left")
    rows = rows.withColumn("conclusion_class", F.coalesce(conclusion_class(F.col("kinds")), F.lit("insufficient")))
    return rows.select("claim_id", "conclusion_class", conclusion_text(F.col("conclusion_class"), F.col("flat"), texts).alias("conclusion"))


def compose_local_answer(
    evidence: DataFrame, questions: DataFrame, lexicon: RelationLexicon = RelationLexicon(), texts: Mapping[str, str] = lx.CONCLUSIONS
) -> DataFrame:
    """(question_id, answer) from classified evidence.

    ``evidence`` is (question_id, position_no, title, content, source_anchor, position, doc_uid,
    relation_type, relation_label).  The answer shows the first four pieces; the conclusion
    and the caution look at all of them, as set and flag, so nothing unbounded is gathered.
    """
    shown = (
        evidence.withColumn("n", F.row_number().over(Window.partitionBy("question_id").orderBy("position_no")))
        .where("n <= 4")
    )
    full = tx.strip(F.coalesce("content", F.lit("")))
    excerpt = F.when(F.length(full) > 180, F.concat(tx.rstrip(F.substring(full, 1, 180)), F.lit("..."))).otherwise(full)
    title = F.coalesce(F.nullif("title", F.lit("")), "source_type")
    place = F.coalesce(F.nullif("source_anchor", F.lit("")), "position", F.lit(""))
    source = F.concat(
        title,
        F.when(place != "", F.concat(F.lit("（"), place, F.lit("）"))).otherwise(""),
        F.when(F.coalesce("doc_uid", F.lit("")) != "", F.concat(F.lit("，文档："), "doc_uid")).otherwise(""),
    )
    parts = shown.groupBy("question_id").agg(
        F.array_sort(
            F.collect_list(
                F.struct(
                    "n",
                    F.concat(F.col("relation_label"), F.lit("："), title).alias("judgement"),
                    excerpt.alias("excerpt"),
                    source.alias("source"),
                )
            )
        ).alias("items")
    )
    overall = evidence.groupBy("question_id").agg(
        F.collect_set("relation_type").alias("kinds"),
        F.bool_or(tx.contains_any(F.coalesce("content", F.lit("")), lexicon.caution)).alias("caution"),
    )
    rows = questions.select("question_id", "question").join(parts, "question_id", "left").join(overall, "question_id", "left")
    flat = flat_text(F.col("question"))
    join = lambda field: F.array_join(tx.non_empty(F.transform("items", lambda i: i[field])), "；")
    points = join("excerpt")
    answer = F.concat_ws(
        "\n\n",
        F.concat(F.lit("结论："), conclusion_text(conclusion_class(F.col("kinds")), flat, texts)),
        F.concat(F.lit("证据判断："), join("judgement")),
        F.concat(F.lit("依据："), F.when(points == "", "当前证据只有命中位置，缺少可判断的正文内容。").otherwise(points)),
        F.concat(F.lit("来源："), join("source")),
        F.concat(
            F.lit("不确定点："),
            F.when(F.col("caution"), "现有证据没有提供针对具体疾病人群的明确疗效结论，且涉及用药指导或禁忌，不能替代医生判断。").otherwise(
                "本地降级回答只基于当前命中的文档证据，未做外部医学事实补充。"
            ),
        ),
    )
    nothing = F.concat_ws(
        "\n\n",
        F.concat(F.lit("结论：证据不足，不能回答“"), "question", F.lit("”。")),
        F.lit("依据：未在当前知识库的 PageIndex 结构或原文片段中找到直接相关证据。"),
        F.lit("来源：无。"),
        F.lit("不确定点：需要补充相关文档或重新构建索引后再判断。"),
    )
    return rows.select("question_id", F.when(F.col("items").isNull(), nothing).otherwise(answer).alias("answer"))


def structure_context(evidence: DataFrame) -> DataFrame:
    """(question_id, context): ``document > title > place`` lines of the first five pieces."""
    place = tx.strip(F.coalesce(F.nullif("source_anchor", F.lit("")), "position", F.lit("")))
    title = tx.strip(F.coalesce(F.nullif("title", F.lit("")), "source_type", F.lit("")))
    doc = tx.strip(F.coalesce("doc_uid", F.lit("")))
    line = F.when((title != "") | (place != ""), F.array_join(tx.non_empty(F.array(doc, title, place)), " > "))
    numbered = evidence.withColumn("n", F.row_number().over(Window.partitionBy("question_id").orderBy("position_no")))
    return (
        numbered.where("n <= 5")
        .groupBy("question_id")
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", line.alias("l")))), lambda s: s["l"]), "\n").alias("context"))
    )


# Question types and the default plan.
QUESTION_TYPES = ("information_extraction", "claim_judgement", "source_location", "comparison", "summary", "unknown")
PLAN_DEFAULTS = {
    "answer_strategy": "先理解用户问题，再严格基于证据回答；证据不足时明确说明不足。",
    "target": "",
    "claim": "",
    "insufficient_evidence_policy": "证据不足时不能编造结论，必须说明当前知识库未提供足够依据。",
}
PLAN_OUTPUT = ("结论", "依据", "来源", "不确定点")
PLAN_SCHEMA = (
    "question_type string, answer_strategy string, target string, claim string, insufficient_evidence_policy string, "
    "required_output array<string>, needs_evidence_relation boolean"
)


def normalize_question_plan(plans: DataFrame) -> DataFrame:
    """Checked plan fields from (question_id, question, payload) with payload as JSON text."""
    rows = plans.withColumn("j", F.from_json("payload", PLAN_SCHEMA))
    text = lambda n, d: F.coalesce(F.nullif(tx.strip(F.col(f"j.{n}")), F.lit("")), d if isinstance(d, Column) else F.lit(d))
    outputs = tx.non_empty(F.transform(F.coalesce("j.required_output", F.array().cast("array<string>")), tx.strip))
    kind = tx.strip("j.question_type")
    return rows.select(
        "question_id",
        F.when(kind.isin(*QUESTION_TYPES), kind).otherwise("unknown").alias("question_type"),
        text("answer_strategy", PLAN_DEFAULTS["answer_strategy"]).alias("answer_strategy"),
        text("target", tx.strip("question")).alias("target"),
        text("claim", "").alias("claim"),
        text("insufficient_evidence_policy", PLAN_DEFAULTS["insufficient_evidence_policy"]).alias("insufficient_evidence_policy"),
        F.when(F.size(outputs) > 0, F.slice(outputs, 1, 8)).otherwise(tx.strings(PLAN_OUTPUT)).alias("required_output"),
        F.coalesce("j.needs_evidence_relation", F.lit(True)).alias("needs_evidence_relation"),
    )
