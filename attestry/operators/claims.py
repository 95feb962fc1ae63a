"""Claims, rules, evidence selection and verdicts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestry import lexicons as lx
from attestry.functions import text as tx
from attestry.lexicons import ClaimLexicon
from attestry.operators import normalize as nz
from attestry.operators.matching import contains_join


def rank_of(value: Column, ranks: dict[str, int], default: int) -> Column:
    """Rank of an enum value; unknown values get the default."""
    expr = F
    for name, rank in ranks.items():
        expr = expr.when(value == name, rank)
    return expr.otherwise(default)


def by_rank(rank: Column, ranks: dict[str, int]) -> Column:
    names = sorted(ranks, key=ranks.get)
    return F.get(tx.strings(names), rank)


# ---------------------------------------------------------------------------- claims
def claim_texts(text: Column) -> Column:
    """Claims between sentence ends, semicolons and line ends; else the whole text."""
    parts = tx.non_empty(F.transform(F.split(F.translate(text, "；;\n", "。。。"), "。"), tx.strip))
    return tx.bind(parts, lambda p: F.when(F.size(p) > 0, p).otherwise(F.array(tx.strip(text))))


def split_claims(texts: DataFrame) -> DataFrame:
    """(check_id, claim_no, claim_id, claim_text); other columns of the texts are kept."""
    keep = [c for c in texts.columns if c not in ("check_id", "input_text")]
    rows = texts.select("check_id", *keep, F.posexplode(claim_texts(F.col("input_text"))).alias("p", "claim_text"))
    no = F.col("p") + 1
    return rows.select(
        "check_id",
        *keep,
        no.alias("claim_no"),
        F.sha2(F.concat_ws(":", F.col("check_id").cast("string"), no.cast("string")), 256).alias("claim_id"),
        "claim_text",
    )


def claim_logic(claims: DataFrame, lexicon: ClaimLexicon = ClaimLexicon()) -> DataFrame:
    return claims.select("*", *[c.alias(n) for n, c in nz.logic_flags(F.col("claim_text"), lexicon).items()])


# ----------------------------------------------------------------------------- rules
def rule_applies(rule_tags: Column, asked: Column) -> Column:
    """No tags asked, no tags on the rule, or a tag in common."""
    own = tx.non_empty(F.transform(F.coalesce(rule_tags, F.array().cast("array<string>")), tx.strip))
    asked = F.coalesce(asked, F.array().cast("array<string>"))
    return (F.size(asked) == 0) | (F.size(F.coalesce(rule_tags, F.array().cast("array<string>"))) == 0) | F.arrays_overlap(own, asked)


RULE_TYPE = (
    "array<struct<rule_no:int,code:string,name:string,keywords:array<string>,hit_level:string,"
    "message:string,template_tags:array<string>>>"
)


def rule_list(rules: DataFrame) -> Column:
    """The rule set as one array value, in rule order.

    Rules are configuration, a few hundred rows at most, so a scalar subquery hands the
    whole set to every task without a join.
    """
    fields = F.struct("rule_no", "code", "name", "keywords", "hit_level", "message", "template_tags")
    return rules.agg(F.array_sort(F.collect_list(fields)).cast(RULE_TYPE).alias("rules")).scalar()


def filter_rules_by_tags(rules: DataFrame, templates: DataFrame) -> DataFrame:
    """(template_id, code): the rules that apply to each template."""
    listed = templates.withColumn("rules", rule_list(rules))
    active = F.filter("rules", lambda r: rule_applies(r["template_tags"], F.col("rule_tags")))
    return listed.select("template_id", F.explode(F.transform(active, lambda r: r["code"])).alias("code"))


def match_rules(claims: DataFrame, rules: DataFrame, tags: str | None = None) -> DataFrame:
    """(check_id, claim_id, rule_no, rule_code, …): rules with a keyword in the claim.

    Rules are tested inside each claim row, so the claim table is read once and never
    shuffled.  ``tags`` names a claim column with the asked tags.
    """
    asked = F.col(tags) if tags else F.array().cast("array<string>")
    text = F.col("claim_text")
    tested = F.transform(
        F.filter("rules", lambda r: rule_applies(r["template_tags"], asked)),
        lambda r: F.struct(
            r.alias("rule"),
            F.get(F.filter(r["keywords"], lambda k: (k != "") & F.contains(text, k)), F.lit(0)).alias("word"),
        ),
    )
    rows = claims.withColumn("rules", rule_list(rules)).select(
        "check_id", "claim_id", F.explode(F.filter(tested, lambda t: t["word"].isNotNull())).alias("t")
    )
    return rows.select(
        "check_id",
        "claim_id",
        F.col("t.rule.rule_no").alias("rule_no"),
        F.coalesce("t.rule.code", F.lit("")).alias("rule_code"),
        F.coalesce("t.rule.name", F.lit("")).alias("rule_name"),
        F.coalesce("t.rule.hit_level", F.lit("warn")).alias("hit_level"),
        F.coalesce("t.rule.message", F.concat(F.lit("命中规则关键词："), F.col("t.word"))).alias("hit_message"),
        F.col("t.word").alias("matched_keyword"),
    )


def match_rule_table(claims: DataFrame, rules: DataFrame, tags: str | None = None) -> DataFrame:
    """The rows of ``match_rules`` for rule tables of any size: keywords are looked up from the claim's n-grams.

    A keyword waits at the one of its n-grams that the fewest claims have, so a claim meets the keywords that wait
    at its own n-grams, not all rules, and no task holds the rule table. Claims are told apart by (check_id,
    claim_id), rules by rule_no; claims without text, rules without keywords and empty keywords match nothing.
    """
    asked = F.col(tags) if tags else F.array().cast("array<string>")
    words = rules.select("rule_no", "template_tags", F.posexplode("keywords").alias("word_no", "keyword")).where("keyword <> ''")
    found = contains_join(
        words.select("keyword", F.col("keyword").alias("word")).distinct(), claims.where("claim_text is not null"),
        needle="word", hay="claim_text", needle_key="keyword", hay_keys=["check_id", "claim_id"], payload=[tags] if tags else [],
    )
    hits = found.join(words, "keyword").where(rule_applies(F.col("template_tags"), asked))
    first = hits.groupBy("check_id", "claim_id", "rule_no").agg(F.min(F.struct("word_no", "keyword")).alias("w"))
    return first.join(rules.select("rule_no", "code", "name", "hit_level", "message"), "rule_no").select(
        "check_id",
        "claim_id",
        F.col("rule_no").cast("int").alias("rule_no"),
        F.coalesce("code", F.lit("")).alias("rule_code"),
        F.coalesce("name", F.lit("")).alias("rule_name"),
        F.coalesce("hit_level", F.lit("warn")).alias("hit_level"),
        F.coalesce("message", F.concat(F.lit("命中规则关键词："), F.col("w.keyword"))).alias("hit_message"),
        F.col("w.keyword").alias("matched_keyword"),
    )


def max_rule_level(rule_hits: DataFrame) -> DataFrame:
    """(claim_id, max_level)."""
    rank = F.max(rank_of(F.col("hit_level"), lx.LEVEL_RANK, 1))
    return rule_hits.groupBy("claim_id").agg(rank.alias("r")).select("claim_id", by_rank(F.col("r"), lx.LEVEL_RANK).alias("max_level"))


# -------------------------------------------------------------------------- relations
# Reason texts.
REASON_RELATED = "检索结果与当前 Claim 主题相关。"
REASON_STRICT = "该 Claim 含强逻辑约束，需要更直接的边界或排他性证据。"
REASON_CONTRADICT = "证据中出现例外、并列对象或范围放宽，和 Claim 的强约束相冲突。"
REASON_RELAXED = "该证据来自放宽逻辑约束后的补充检索，用于检查例外、边界或反证。"
REASON_PROBE = "该证据来自反证探测查询，用于补召回例外、相反条件或边界约束。"
REASON_LITERAL = "该证据和原始 Claim 最接近，但还没有直接覆盖其强约束本身。"
REASON_SUPPORT = {
    "has_exclusive": "证据中直接出现“只有/唯一”等排他表达，覆盖了 Claim 的唯一性约束。",
    "has_universal": "证据中直接出现“所有/全部”等全称表达，更接近对 Claim 全范围结论的支持。",
    "has_negation": "证据中直接出现否定性约束，能够更直接地支撑 Claim 的否定结论。",
    "has_comparison": "证据中直接出现比较表达，能够更直接地支撑 Claim 的比较结论。",
}


SIGNALS = ("exclusive", "universal", "negation", "comparison", "counter_exclusive", "counter_universal", "counter_negation", "counter_comparison", "unless_universal")


def text_signals(text: Column, lexicon: ClaimLexicon) -> Column:
    """Which of the lexicon's lists a text has a word of, as a struct; all that relations need of a text."""
    return F.struct(*[((text != "") & tx.contains_any(text, getattr(lexicon, n))).alias(n) for n in SIGNALS], (text != "").alias("written"))


def counter_signal(signals: Column) -> Column:
    """Whether a text speaks against a claim's constraints (flags as columns)."""
    kinds = ("exclusive", "universal", "negation", "comparison")
    return reduce(lambda a, b: a | b, [F.col(f"has_{k}") & signals[f"counter_{k}"] for k in kinds])


def strict_support(signals: Column, labels: Column) -> Column:
    """Whether a text covers the first constraint that is set."""
    literal = F.array_contains(labels, "claim_literal")
    return signals["written"] & (
        F.when(F.col("has_exclusive"), signals["exclusive"] & ~signals["counter_exclusive"])
        .when(F.col("has_universal"), signals["universal"] & ~signals["unless_universal"])
        .when(F.col("has_negation"), signals["negation"] & literal)
        .when(F.col("has_comparison"), signals["comparison"] & literal)
        .otherwise(F.lit(False))
    )


def with_flags(evidence: DataFrame, claims: DataFrame, lexicon: ClaimLexicon = ClaimLexicon()) -> DataFrame:
    """Evidence with the logic flags of its claim; best joined before the texts are fetched."""
    return evidence.join(claim_logic(claims.select("claim_id", "claim_text"), lexicon).drop("claim_text"), "claim_id")


def annotate_relations(evidence: DataFrame, claims: DataFrame, lexicon: ClaimLexicon = ClaimLexicon()) -> DataFrame:
    """Evidence with its relation to the claim, the reason and whether its text speaks against the claim (``counter``).

    Evidence may carry the claim's flags and, instead of texts, their ``signals``.
    """
    rows = evidence if "is_strict" in evidence.columns else with_flags(evidence, claims, lexicon)
    columns = [c for c in rows.columns if c != "signals"]
    if "signals" not in rows.columns:
        rows = rows.withColumn("evidence_text", F.coalesce(F.nullif("expanded_content", F.lit("")), "content", F.lit("")))
        rows = rows.withColumn("signals", text_signals(F.col("evidence_text"), lexicon))
        columns = [*columns, "evidence_text"]
    labels, signals = F.col("matched_queries"), F.col("signals")
    rows = rows.withColumn("counter", counter_signal(signals)).withColumn("covers", strict_support(signals, labels))
    strict = F.col("is_strict")
    relation = F.when(~strict, "support").when(F.col("counter"), "contradict").when(F.col("covers"), "support").otherwise("insufficient")
    support_reason = F.when(F.col("has_exclusive"), REASON_SUPPORT["has_exclusive"])
    for flag in ("has_universal", "has_negation", "has_comparison"):
        support_reason = support_reason.when(F.col(flag), REASON_SUPPORT[flag])
    reason = (
        F.when(~strict, REASON_RELATED)
        .when(F.col("counter"), REASON_CONTRADICT)
        .when(F.col("covers"), support_reason)
        .when(F.array_contains(labels, "logic_relaxed"), REASON_RELAXED)
        .when(F.array_contains(labels, "counter_probe"), REASON_PROBE)
        .when(F.array_contains(labels, "claim_literal"), REASON_LITERAL)
        .otherwise(REASON_STRICT)
    )
    return rows.select(
        *columns, "counter", relation.alias("evidence_relation"), reason.alias("relation_reason"),
    )


def _order_keys() -> list[Column]:
    labels = F.col("matched_queries")
    bonus = F.when(F.array_contains(labels, "counter_probe"), 2).otherwise(0) + F.when(F.array_contains(labels, "topic_focus"), 1).otherwise(0)
    return [
        rank_of(F.col("evidence_relation"), lx.RELATION_RANK, 2).asc(),
        F.size(labels).desc(),
        bonus.desc(),
        F.coalesce("rerank_score", F.lit(0.0)).desc(),
        F.col("rank").asc(),
    ]


def order_evidence(annotated: DataFrame) -> DataFrame:
    """Contradicting first, then supporting; by labels, label bonus and score."""
    order = Window.partitionBy("claim_id").orderBy(*_order_keys())
    return annotated.withColumn("order_no", F.row_number().over(order))


def select_evidence(annotated: DataFrame, final_top_k=None) -> DataFrame:
    """The k pieces of evidence kept per claim, in reading order (``selected_no``).

    One slot is reserved for support when both sides are present and k >= 3; insufficient
    pieces fill what is left, at most one when two or more contradict.
    """
    k = F.greatest(F.col("final_top_k") if final_top_k is None else F.lit(final_top_k), F.lit(1))
    labels = F.col("matched_queries")
    claim = Window.partitionBy("claim_id")
    kind = F.col("evidence_relation")
    fill_order = [
        F.array_contains(labels, "claim_literal").cast("int").desc(),
        F.array_contains(labels, "counter_probe").cast("int").desc(),
        F.when((F.size(labels) == 1) & F.array_contains(labels, "topic_focus"), 1).otherwise(0).asc(),
        F.coalesce("rerank_score", F.lit(0.0)).desc(),
        F.col("order_no").asc(),
    ]
    rows = order_evidence(annotated)
    for name in ("contradict", "support", "insufficient"):
        rows = rows.withColumn(f"n_{name}", F.count(F.when(kind == name, 1)).over(claim))
    rows = rows.withColumn("class_no", F.row_number().over(Window.partitionBy("claim_id", "evidence_relation").orderBy("order_no")))
    rows = rows.withColumn("fill_no", F.row_number().over(Window.partitionBy("claim_id", "evidence_relation").orderBy(*fill_order)))
    reserve = F.when((F.col("n_contradict") > 0) & (F.col("n_support") > 0) & (k >= 3), 1).otherwise(0)
    rows = rows.withColumn("c", F.least("n_contradict", k - reserve))
    rows = rows.withColumn("s", F.least("n_support", k - F.col("c")))
    rest = F.least("n_insufficient", k - F.col("c") - F.col("s"))
    rows = rows.withColumn("i", F.when(F.col("n_contradict") >= 2, F.least(rest, F.lit(1))).otherwise(rest))
    keep = (
        F.when(kind == "contradict", F.col("class_no") <= F.col("c"))
        .when(kind == "support", F.col("class_no") <= F.col("s"))
        .otherwise(F.col("fill_no") <= F.col("i"))
    )
    position = Window.partitionBy("claim_id").orderBy(
        rank_of(kind, lx.RELATION_RANK, 2), F.when(kind == "insufficient", F.col("fill_no")).otherwise(F.col("class_no"))
    )
    return rows.where(keep).withColumn("selected_no", F.row_number().over(position)).drop(
        "n_contradict", "n_support", "n_insufficient", "class_no", "fill_no", "c", "s", "i"
    )


def detect_counter_evidence(selected: DataFrame, lexicon: ClaimLexicon = ClaimLexicon()) -> DataFrame:
    """(claim_id, evidence_count, contradict_count, support_count, has_counter).

    Markers are looked for in all evidence of the claim; that one of them sits in some
    piece is the same as sitting in the joined text, as markers hold no line end.
    """
    counter = F.col("counter") if "counter" in selected.columns else counter_signal(text_signals(F.col("evidence_text"), lexicon))
    return selected.groupBy("claim_id").agg(
        F.count(F.lit(1)).alias("evidence_count"),
        F.count_if(F.col("evidence_relation") == "contradict").alias("contradict_count"),
        F.count_if(F.col("evidence_relation") == "support").alias("support_count"),
        F.bool_or(F.col("is_strict") & ((F.col("evidence_relation") == "contradict") | counter)).alias("has_counter"),
    )


# --------------------------------------------------------------------------- verdicts
# Verdict reasons.
REASON_BLOCK = "命中阻断级规则，当前内容不能直接放行。"
REASON_ERROR = "命中高风险规则，当前证据不足以直接放行。"
REASON_WARN = "命中提示级规则，建议结合更直接证据继续核对。"
REASON_VERIFIED = "已检索到直接相关且未见明显冲突的支持证据。"
REASON_NONE = "当前未检索到足够直接的证据，建议人工复核。"


def heuristic_reason() -> Column:
    """Reason text for a claim decided by counter-evidence or by its strictness."""
    lead = lambda tail: F.concat(F.lit("Claim“"), F.substring("claim_text", 1, 28), tail if isinstance(tail, Column) else F.lit(tail))
    contradict = F.when(
        F.col("contradict_count") > 0,
        lead(F.concat(F.lit("”检索到 "), F.col("contradict_count").cast("string"), F.lit(" 条矛盾证据，说明其排他或绝对化约束被反证。"))),
    ).otherwise(lead("”存在明显反证线索，当前不能判定为通过。"))
    insufficient = (
        F.when(F.col("has_exclusive"), lead("”包含“只有/唯一”类排他表述，现有证据不足以证明其唯一性。"))
        .when(F.col("has_universal"), lead("”包含“所有/全部”类全称表述，现有证据不足以覆盖其全部范围。"))
        .when(F.col("has_negation"), lead("”包含否定性约束，现有证据不足以证明该否定结论始终成立。"))
        .when(F.col("has_comparison"), lead("”包含比较型结论，现有证据不足以支撑其比较优势或劣势。"))
        .when(
            F.col("support_count") > 0,
            lead(F.concat(F.lit("”有 "), F.col("support_count").cast("string"), F.lit(" 条相关证据，但直接性仍不足，建议继续复核。"))),
        )
        .otherwise(lead("”当前缺少足够直接的证据支持。"))
    )
    return F.when(F.col("has_counter"), contradict).otherwise(insufficient)


def claim_state(claims: DataFrame, selected: DataFrame, rule_hits: DataFrame, lexicon: ClaimLexicon = ClaimLexicon()) -> DataFrame:
    """Claims with their flags, evidence counts and highest rule level."""
    return (
        claim_logic(claims, lexicon)
        .join(detect_counter_evidence(selected, lexicon), "claim_id", "left")
        .join(max_rule_level(rule_hits), "claim_id", "left")
        .na.fill({"evidence_count": 0, "contradict_count": 0, "support_count": 0, "has_counter": False})
    )


def heuristic_verdict(claims: DataFrame, selected: DataFrame, rule_hits: DataFrame, lexicon: ClaimLexicon = ClaimLexicon()) -> DataFrame:
    """Verdict, confidence, risk, judgement and reason per claim."""
    state = claim_state(claims, selected, rule_hits, lexicon)
    level, has = F.col("max_level"), F.col("evidence_count") > 0
    outcome = lambda verdict, confidence, risk, judgement, reason: F.struct(
        F.lit(verdict).alias("verdict"),
        (confidence if isinstance(confidence, Column) else F.lit(confidence)).alias("confidence"),
        (risk if isinstance(risk, Column) else F.lit(risk)).alias("risk_level"),
        F.lit(judgement).alias("evidence_judgement"),
        (reason if isinstance(reason, Column) else F.lit(reason)).alias("reason"),
    )
    decided = (
        F.when(level == "block", outcome("rejected", 0.15, "high", "contradict", REASON_BLOCK))
        .when(F.col("has_counter"), outcome("rejected", 0.25, "high", "contradict", heuristic_reason()))
        .when(level == "error", outcome("needs_review", 0.35, "high", "insufficient", REASON_ERROR))
        .when(level == "warn", outcome("needs_review", 0.55, "medium", "insufficient", REASON_WARN))
        .when(
            F.col("is_strict"),
            outcome(
                "needs_review",
                F.when(has, 0.45).otherwise(0.2),
                F.when(F.col("has_exclusive") | F.col("has_negation"), "high").otherwise("medium"),
                "insufficient",
                heuristic_reason(),
            ),
        )
        .when(has, outcome("verified", 0.85, "low", "support", REASON_VERIFIED))
        .otherwise(outcome("needs_review", 0.2, "medium", "insufficient", REASON_NONE))
    )
    return state.withColumn("o", decided).select("check_id", "claim_no", "claim_id", "claim_text", has.alias("has_evidence"), "evidence_count", "max_level", "o.*")


def coerce_verdict(value: Column) -> Column:
    return F.when(value.isin(*lx.VERDICT_RANK), value).otherwise("needs_review")


def coerce_relation(value: Column) -> Column:
    low = F.lower(value)
    return F.when(low.isin(*lx.RELATION_RANK), low).otherwise("insufficient")


def coerce_enums(rows: DataFrame) -> DataFrame:
    return rows.withColumn("verdict", coerce_verdict(F.col("verdict"))).withColumn("evidence_judgement", coerce_relation(F.col("evidence_judgement")))


def merge_verdicts(heuristic: DataFrame, model: DataFrame) -> DataFrame:
    """The more conservative of heuristic and model verdict per claim.

    ``model`` is (claim_id, verdict, confidence, risk_level, evidence_judgement, reason); a
    claim without a model row keeps its heuristic verdict.  Whether there is evidence is carried over where it is known.
    """
    m = model.select("claim_id", *[F.col(c).alias(f"m_{c}") for c in ("verdict", "confidence", "risk_level", "evidence_judgement", "reason")])
    rows = heuristic.join(m, "claim_id", "left")
    has_model = F.col("m_verdict").isNotNull() | F.col("m_confidence").isNotNull()
    said = F.lower(F.coalesce("m_evidence_judgement", F.lit("")))
    relation = coerce_relation(F.when(said == "", F.col("evidence_judgement")).otherwise(said))
    raw = coerce_verdict(F.coalesce(F.nullif("m_verdict", F.lit("")), "verdict"))
    model_verdict = F.when(relation == "contradict", "rejected").when((relation == "insufficient") & (raw == "verified"), "needs_review").otherwise(raw)
    rows = rows.withColumn("model_verdict", model_verdict).withColumn("relation", relation)
    rank = F.greatest(rank_of(coerce_verdict(F.col("verdict")), lx.VERDICT_RANK, 1), rank_of(F.col("model_verdict"), lx.VERDICT_RANK, 1))
    final = by_rank(rank, lx.VERDICT_RANK)
    confidence = F.coalesce("m_confidence", "confidence")
    m_risk = F.coalesce(F.nullif("m_risk_level", F.lit("")), "risk_level")
    risk = F.when(rank_of(m_risk, lx.RISK_RANK, 1) > rank_of(F.col("risk_level"), lx.RISK_RANK, 1), m_risk).otherwise(F.col("risk_level"))
    pick = lambda merged, own: F.when(has_model, merged).otherwise(F.col(own))
    return rows.select(
        "claim_id",
        pick(final, "verdict").alias("verdict"),
        pick(F.when(final == F.col("model_verdict"), confidence).otherwise(F.least(confidence, F.col("confidence"))), "confidence").alias("confidence"),
        pick(risk, "risk_level").alias("risk_level"),
        pick(F.when(said == "", F.col("relation")).otherwise(said), "evidence_judgement").alias("evidence_judgement"),
        pick(F.coalesce(F.nullif("m_reason", F.lit("")), "reason"), "reason").alias("reason"),
        *[c for c in ("has_evidence",) if c in heuristic.columns],
    )


def parse_model_output(outputs: DataFrame, key: str = "claim_id", text: str = "output") -> DataFrame:
    """Verdict fields from free model text: outermost braces, enum checks, clamped confidence.

    Text without a JSON object gives ``parsed`` false and null fields.
    """
    body = F.regexp_extract(F.coalesce(F.col(text), F.lit("")), r"(?s)(\{.*\})", 1)
    inner = "verdict string, evidence_judgement string, confidence string, risk_level string, reason string"
    struct = F.from_json(body, f"{inner}, interpretation struct<{inner.replace(' string', ':string')}>")
    rows = outputs.select(key, struct.alias("j"), F.try_parse_json(body).isNotNull().alias("valid"))
    field = lambda n: F.when(F.col("j.verdict").isNull() & F.col("j.interpretation").isNotNull(), F.col(f"j.interpretation.{n}")).otherwise(F.col(f"j.{n}"))
    checked = lambda n, allowed, default: F.when(field(n).isin(*allowed), field(n)).otherwise(default)
    number = F.coalesce(field("confidence").try_cast("double"), F.lit(0.2))
    ok = F.col("valid")
    return rows.select(
        key,
        ok.alias("parsed"),
        F.when(ok, checked("verdict", lx.VERDICT_RANK, "needs_review")).alias("verdict"),
        F.when(ok, checked("evidence_judgement", lx.RELATION_RANK, "insufficient")).alias("evidence_judgement"),
        F.when(ok, F.greatest(F.lit(0.0), F.least(F.lit(1.0), number))).alias("confidence"),
        F.when(ok, checked("risk_level", lx.RISK_RANK, "medium")).alias("risk_level"),
        F.when(ok, F.coalesce(field("reason"), F.lit(""))).alias("reason"),
    )


USER_PROMPT = "Claim: {claim_text}\n\nEvidence:\n{evidence_block}\n\nRules:\n{rule_block}\n\nLogic:\n{claim_logic_block}\n\nAnswer with one JSON object."


def build_prompts(claims: DataFrame, selected: DataFrame, rule_hits: DataFrame, template: str = USER_PROMPT, lexicon: ClaimLexicon = ClaimLexicon()) -> DataFrame:
    """(claim_id, prompt): the template with evidence, rule and logic lines filled in."""
    dash = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit("-"))
    evidence_line = F.concat(
        F.lit("- 文档: "), F.col("doc_uid"), F.lit(" | 位置: "), F.col("source_span"),
        F.lit(" | 查询来源: "), dash(F.array_join("matched_queries", "/")),
        F.lit(" | 证据关系: "), dash(F.col("evidence_relation")),
        F.lit(" | 关系说明: "), dash(F.col("relation_reason")),
        F.lit(" | 内容: "), F.substring("evidence_text", 1, 400),
    )
    lines = lambda key, line: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), line.alias("l")))), lambda s: s["l"]), "\n")
    evidence = selected.groupBy("claim_id").agg(lines("selected_no", evidence_line).alias("evidence_block"))
    rule_line = F.concat(F.lit("- 规则: "), F.col("rule_code"), F.lit(" | 等级: "), F.col("hit_level"), F.lit(" | 原因: "), F.col("hit_message"))
    rules = rule_hits.groupBy("claim_id").agg(lines("rule_no", rule_line).alias("rule_block"))
    rows = claim_logic(claims, lexicon).join(evidence, "claim_id", "left").join(rules, "claim_id", "left")
    logic = F.concat_ws(
        "\n",
        *[F.concat(F.lit(f"- {name}: "), F.when(F.col(flag), "yes").otherwise("no")) for name, flag in
          (("exclusive", "has_exclusive"), ("universal", "has_universal"), ("negation", "has_negation"), ("comparison", "has_comparison"))],
    )
    # The claim goes in last so that braces in it are never taken for a slot.
    prompt = F.replace(F.lit(template), F.lit("{claim_logic_block}"), logic)
    prompt = F.replace(prompt, F.lit("{rule_block}"), F.coalesce("rule_block", F.lit("- 无规则命中")))
    prompt = F.replace(prompt, F.lit("{evidence_block}"), F.coalesce("evidence_block", F.lit("- 无证据")))
    return rows.select("claim_id", F.replace(prompt, F.lit("{claim_text}"), F.col("claim_text")).alias("prompt"))


# ----------------------------------------------------------------------------- checks
def overall_verdict(verdicts: DataFrame) -> DataFrame:
    v = coerce_verdict(F.col("verdict"))
    rejected, clean = F.bool_or(v == "rejected"), F.bool_and(v == "verified")
    return verdicts.groupBy("check_id").agg(
        F.when(rejected, "rejected").when(clean, "passed").otherwise("needs_review").alias("overall_verdict")
    )


def overall_risk(verdicts: DataFrame) -> DataFrame:
    top = F.max(rank_of(F.col("risk_level"), lx.RISK_RANK, 0))
    return verdicts.groupBy("check_id").agg(by_rank(top, lx.RISK_RANK).alias("risk_level"))


def check_summary(verdicts: DataFrame, rule_hits: DataFrame) -> DataFrame:
    """Counts of claims by verdict and of rule hits, with the summary text."""
    hits = rule_hits.groupBy("check_id").agg(F.count(F.lit(1)).alias("rule_hit_count"))
    n = lambda v: F.count_if(F.col("verdict") == v)
    rows = verdicts.groupBy("check_id").agg(
        F.count(F.lit(1)).alias("claim_count"),
        n("verified").alias("verified_count"),
        n("needs_review").alias("needs_review_count"),
        n("rejected").alias("rejected_count"),
    ).join(hits, "check_id", "left").na.fill({"rule_hit_count": 0})
    text = F.format_string(
        "共 %d 条 claim，verified %d 条，needs_review %d 条，rejected %d 条，命中规则 %d 条。",
        "claim_count", "verified_count", "needs_review_count", "rejected_count", "rule_hit_count",
    )
    return rows.withColumn("summary", text)


def retrieval_policy(checks: DataFrame, policies: DataFrame) -> DataFrame:
    """Checks with the limits of their template, defaults where one is missing."""
    rows = checks.join(policies, "template_id", "left")
    return rows.select(*checks.columns, *[F.coalesce(F.col(n), F.lit(d)).alias(n) for n, d in lx.CHECK_POLICY.items()])


def evidence_details(selected: DataFrame) -> DataFrame:
    """(claim_id, evidence_details): 13 fields per piece, in reading order."""
    blank = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    fields = F.struct(
        F.col("selected_no").alias("no"),
        F.struct(
            "chunk_id", "doc_uid", blank("doc_title"), "source_span", blank("retrieval_source"), "matched_sources", "matched_queries",
            "rerank_score", F.coalesce("context_mode", F.lit("chunk")).alias("context_mode"), blank("section_title"),
            "evidence_relation", "relation_reason", F.substring("evidence_text", 1, 300).alias("content_preview"),
        ).alias("d"),
    )
    return selected.groupBy("claim_id").agg(
        F.transform(F.array_sort(F.collect_list(fields), lambda a, b: a["no"] - b["no"]), lambda s: s["d"]).alias("evidence_details")
    )


def verify_persisted(written: DataFrame, expected: DataFrame) -> DataFrame:
    """Claim count per check as written against the input."""
    count = lambda df, n: df.groupBy("check_id").agg(F.count(F.lit(1)).alias(n))
    joined = count(expected, "expected_count").join(count(written, "written_count"), "check_id", "full_outer").na.fill(0)
    return joined.withColumn("persist_verified", F.col("expected_count") == F.col("written_count"))
