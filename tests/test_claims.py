import itertools

from pyspark.sql import functions as F

from attestry import lexicons as lx
from attestry.operators import claims as cl
from attestry.operators import normalize as nz
from attestry.operators import relation as rl
from attestry.sources.files import rule_rows


def test_claims_split_at_sentence_ends(spark):
    df = spark.createDataFrame([("c1", "甲。乙；丙;丁\n戊"), ("c2", " 。 ")], "check_id string, input_text string")
    got = {r.check_id: r.t for r in cl.split_claims(df).groupBy("check_id").agg(F.array_sort(F.collect_list("claim_text")).alias("t")).collect()}
    assert sorted(got["c1"]) == sorted(["甲", "乙", "丙", "丁", "戊"])
    assert got["c2"] == ["。"]


def test_aliases_expand_queries(spark):
    df = spark.createDataFrame([("q", "驢皮膠 补血")], "query_id string, text string")
    texts = [r.text for r in nz.expand_queries(df, limit=8).orderBy("variant_no").collect()]
    assert texts[0] == "驢皮膠 补血" and "阿胶 补血" in texts and "东阿阿胶 补血" in texts


def test_strict_claim_gets_a_counter_probe(spark):
    df = spark.createDataFrame([("c", "只有甲地出产乙物")], "claim_id string, claim_text string")
    rows = {r.label: r.text for r in nz.build_retrieval_queries(df).collect()}
    assert rows["claim_literal"] == "只有甲地出产乙物" and rows["logic_relaxed"] == "甲地出产乙物"
    assert rows["counter_probe"].endswith("也有 并非唯一")


def test_rules_report_the_first_keyword_and_respect_tags(spark):
    rules = rule_rows(spark, [
        {"code": "A", "keywords": ["zz", "b", "a"], "template_tags": ["general"]}, "no record",
        {"code": "B", "keywords": ["a"], "hit_level": "block", "message": "m", "template_tags": ["strict"]},
    ])
    claims = spark.createDataFrame([("k", "c", "a b", ["general"])], "check_id string, claim_id string, claim_text string, tags array<string>")
    rows = cl.match_rules(claims, rules, "tags").collect()
    assert [(r.rule_code, r.matched_keyword, r.hit_level) for r in rows] == [("A", "b", "warn")]
    assert {r.rule_code for r in cl.match_rules(claims, rules).collect()} == {"A", "B"}


def test_rule_table_finds_what_rules_in_every_row_find(spark):
    """Thousands of rules, keywords of one to five characters, one of them in most claims, tags, nulls, ties."""
    word = lambda k: "".join("abcdefg"[(k * m + m * m) % 7] for m in range(1, 2 + k % 5))
    rules = rule_rows(spark, [
        {"code": f"R{k}", "keywords": [word(k), "", word(k * 3 + 1)], "template_tags": [[], ["x"], ["y", "z"]][k % 3], **({"message": "m"} if k % 2 else {})} for k in range(2000)
    ] + [{"code": "none", "keywords": []}])
    rows = [(k % 4, k, None if k == 7 else "" if k == 8 else "ab " + " ".join(word(k * j + j) for j in range(k % 6)), [["x"], [], None][k % 3]) for k in range(60)]
    claims = spark.createDataFrame(rows, "check_id int, claim_id int, claim_text string, tags array<string>")
    for tags in ("tags", None):
        found = sorted(map(tuple, cl.match_rule_table(claims, rules, tags).collect()))
        assert found == sorted(map(tuple, cl.match_rules(claims, rules, tags).collect())) and len(found) > 1000
    assert cl.match_rule_table(claims, rules.limit(0)).collect() == [] and cl.match_rule_table(claims.limit(0), rules).collect() == []


def simulate(c, s, n, k):
    """Quotas step by step: contradict first, one reserved support, support, insufficient."""
    reserve = 1 if c and s and k >= 3 else 0
    taken_c = min(c, k - reserve)
    left = k - taken_c
    taken_s = 1 if reserve and left else 0
    left -= taken_s
    more = min(s - taken_s, left)
    taken_s, left = taken_s + more, left - more
    room = min(left, 1) if c >= 2 else left
    return taken_c, taken_s, min(n, room)


def test_selection_quotas_equal_a_simulation(spark):
    cases = list(itertools.product(range(4), range(4), range(4), range(1, 6)))
    rows = []
    for c, s, n, k in cases:
        kinds = ["contradict"] * c + ["support"] * s + ["insufficient"] * n
        rows += [(f"{c}-{s}-{n}-{k}", k, kind, f"x{i}", i + 1) for i, kind in enumerate(kinds)]
    df = spark.createDataFrame(rows, "claim_id string, final_top_k int, evidence_relation string, chunk_id string, rank int")
    df = df.withColumn("matched_queries", F.array(F.lit("claim_literal"))).withColumn("rerank_score", F.lit(None).cast("double"))
    got = {(r.claim_id, r.evidence_relation): r["count"] for r in cl.select_evidence(df).groupBy("claim_id", "evidence_relation").count().collect()}
    for c, s, n, k in cases:
        found = tuple(got.get((f"{c}-{s}-{n}-{k}", kind), 0) for kind in ("contradict", "support", "insufficient"))
        assert found == simulate(c, s, n, k), (c, s, n, k)


def test_model_output_is_checked(spark):
    rows = [
        ("a", 'x {"verdict": "verified", "evidence_judgement": "support", "confidence": 3, "risk_level": "low"} y'),
        ("b", '{"verdict": "sure", "confidence": "much"}'), ("c", "nothing"),
    ]
    out = {r.claim_id: r for r in cl.parse_model_output(spark.createDataFrame(rows, "claim_id string, output string")).collect()}
    assert (out["a"].verdict, out["a"].confidence) == ("verified", 1.0)
    assert (out["b"].verdict, out["b"].confidence, out["b"].risk_level) == ("needs_review", 0.2, "medium")
    assert not out["c"].parsed and out["c"].verdict is None


def test_overall_verdict_is_monotone(spark):
    df = spark.createDataFrame(
        [("a", "verified"), ("a", "verified"), ("b", "verified"), ("b", "needs_review"), ("c", "rejected"), ("c", "verified")], "check_id string, verdict string"
    )
    assert {r.check_id: r.overall_verdict for r in cl.overall_verdict(df).collect()} == {"a": "passed", "b": "needs_review", "c": "rejected"}


def test_relations_on_default_lists(spark):
    pairs = spark.createDataFrame(
        [
            ("1", "阿胶可以缓解痛经", "", "温经汤方中含有阿胶，整体缓解痛经"),
            # One of three terms is too little overlap for a refutation, two are enough.
            ("2", "接口允许开放", "", "接口禁止开放"),
            ("5", "接口允许开放", "", "该接口禁止开放，不允许调用"),
            ("3", "制度允许审批", "", "某次案例"),
            ("4", "甲乙丙丁", "", ""),
        ],
        "claim_id string, claim_text string, title string, content string",
    ).withColumn("evidence_id", F.lit("e"))
    got = {r.claim_id: r.relation_type for r in rl.classify_relation(pairs).collect()}
    assert got["1"] == "method_or_formula_context"
    assert (got["2"], got["5"]) == ("context_only", "direct_refute")
    assert got["3"] == "example_only"
    assert got["4"] == "insufficient"


def test_marker_rules_append_without_duplicates():
    merged = rl.merge_marker_rules(lx.RelationLexicon(), {"refute": ["禁止", "新词"], "unknown": ["x"]})
    assert merged.refute[-1] == "新词" and merged.refute.count("禁止") == 1


# ------------------------------------------------------------------ whole checks
def small_corpus(spark, folder):
    from attestry.plans.corpus import derive, store

    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    line = lambda i, k: " ".join(words[(i * 3 + k * 7 + j * j) % 10] for j in range(14)) + f" tail{i}{k}"
    rows = [(f"d{i}", f"kb{i % 2}", f"T{i}", "\n".join(["# Head"] + [line(i, k) + "\n" for k in range(4)] + ["# Next"] + [line(i, k + 4) + "\n" for k in range(3)])) for i in range(8)]
    docs = spark.createDataFrame(rows, "doc_uid string, knowledge_base_id string, doc_title string, content string")
    stamp = F.timestamp_seconds(F.lit(1700000000))
    extra = {"doc_id": F.col("doc_uid"), "author": F.lit("a"), "source_name": F.lit("s"), "tags_json": F.lit("[]"), "source_path": F.concat("doc_uid", F.lit(".md")), "ingest_status": F.lit("completed"), "index_status": F.lit("indexed"), "created_at": stamp, "updated_at": stamp}
    return store(derive(docs.withColumns(extra)), str(folder))


def test_every_check_has_its_own_policy(spark, tmp_path):
    from attestry.plans.check import run_check
    from attestry.sources.files import rule_rows

    corpus = small_corpus(spark, tmp_path / "corpus")
    rules = rule_rows(spark, [{"code": "R", "name": "r", "keywords": ["zeta"], "hit_level": "warn", "template_tags": ["t"]}])
    small = {**lx.CHECK_POLICY, "final_top_k": 2, "vector_top_k": 3}
    large = {**lx.CHECK_POLICY, "final_top_k": 6, "vector_top_k": 12, "fulltext_top_k": 9, "use_rerank": True, "neighbor_window": 1, "include_section_context": True, "section_max_chars": 60}
    text = "alpha beta gamma。only zeta eta theta；nothing here"
    rows = [("a", text, "kb0", ["t"], *small.values()), ("b", text, "kb0", ["u"], *large.values()), ("c", text, "kb1", None, *small.values()), ("d", "kappa iota", None, None, *([None] * 7))]
    kinds = "fulltext_top_k int, vector_top_k int, final_top_k int, use_rerank boolean, neighbor_window int, include_section_context boolean, section_max_chars int"
    assert [k.split()[0] for k in kinds.split(", ")] == list(lx.CHECK_POLICY)
    texts = spark.createDataFrame(rows, f"check_id string, input_text string, knowledge_base_id string, tags array<string>, {kinds}")
    prefer = lambda query, contents: [(n, float(sum(map(ord, c)) % 97)) for n, c in enumerate(contents)]

    def found(result):
        claims = {(r.check_id, r.claim_no): (r.verdict, r.evidence_count, r.evidence, r.source_doc, str(r.evidence_details)) for r in result.claims.collect()}
        return claims, {(r.check_id, r.claim_id, r.rule_code) for r in result.rule_hits.collect()}

    together, hits = found(run_check(texts, corpus, rules, tags="tags", reranker=prefer))
    plain = texts.drop(*lx.CHECK_POLICY)
    for check, policy in (("a", small), ("b", large), ("c", small), ("d", lx.CHECK_POLICY)):
        alone, own = found(run_check(plain.where(F.col("check_id") == check), corpus, rules, policy=policy, tags="tags", reranker=prefer))
        assert alone == {k: v for k, v in together.items() if k[0] == check}
        assert own == {h for h in hits if h[0] == check}
    assert {h[0] for h in hits} == {"a", "c"}  # the rule's tag is not among those of b; d has no zeta
    details = lambda c: "".join(v[4] for k, v in together.items() if k[0] == c)
    assert "section_context" in details("b") and "section_context" not in details("a")
    assert "rerank_score=None" not in details("b") and "rerank_score=None" in details("a")


def test_judge_is_merged_and_may_fail(spark, tmp_path):
    from attestry.plans.check import run_check
    from attestry.sources.files import rule_rows

    corpus = small_corpus(spark, tmp_path / "corpus")
    rules = rule_rows(spark, [{"code": "R", "name": "r", "keywords": ["zeta"], "hit_level": "warn", "template_tags": []}])
    texts = spark.createDataFrame([("a", "alpha beta", "d0"), ("b", "kappa iota", "d1"), ("c", "alpha beta", "gone")], "check_id string, input_text string, doc_uid string")

    def judge(system, prompt):
        if "kappa iota" in prompt.split("\n")[0]:
            raise RuntimeError("refused")
        return '{"verdict": "rejected", "evidence_judgement": "contradict", "confidence": 0.7, "risk_level": "high", "reason": "said"}'

    plain = {r.check_id: r for r in run_check(texts, corpus, rules).claims.collect()}
    told = {r.check_id: r for r in run_check(texts, corpus, rules, judge=judge).claims.collect()}
    assert (told["a"].verdict, told["a"].reason, told["a"].risk_level) == ("rejected", "said", "high") and told["a"].has_evidence == plain["a"].has_evidence
    assert (told["b"].verdict, told["b"].reason) == (plain["b"].verdict, plain["b"].reason)
    assert not plain["c"].has_evidence and plain["c"].source_doc == "gone"


def test_relations_hold_without_the_texts(spark):
    """Flags joined before the texts and signals kept as columns give what the texts give, so texts needn't be shuffled by claim."""
    claims = spark.createDataFrame([("a", "只有甲可以"), ("b", "所有都是"), ("c", "普通说法")], "claim_id string, claim_text string")
    found = [(c, f"{c}{k}", k, ["claim_literal"], 0.0, t) for c in "abc" for k, t in enumerate(("只有甲", "除了甲还可以", "例外也有", ""), 1)]
    rows = spark.createDataFrame(found, "claim_id string, chunk_id string, rank int, matched_queries array<string>, rerank_score double, content string").withColumn("expanded_content", F.col("content"))
    whole = cl.annotate_relations(rows, claims)
    thin = cl.annotate_relations(cl.with_flags(rows, claims), claims).drop("content", "expanded_content", "evidence_text")
    collected = lambda df: sorted(map(tuple, df.collect()))
    assert collected(whole.select(*thin.columns)) == collected(thin)
    ends = lambda df: collected(cl.detect_counter_evidence(cl.select_evidence(df, 4)))
    assert ends(thin) == ends(whole.drop("counter")) and any(r[4] for r in ends(thin))
