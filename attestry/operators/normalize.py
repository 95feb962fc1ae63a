"""Text normalisation and query building as column expressions over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.functions import text as tx
from attestry.lexicons import DEFAULT_DICTIONARY, ClaimLexicon, QuestionLexicon, TermDictionary
from attestry.operators.structure import compact

SENTENCE_MARKS = r"[，。！？；：、“”‘’\"'（）()\[\]{}<>《》]+"


# ------------------------------------------------------------------ dictionary terms
def normalized(text: Column, dictionary: TermDictionary = DEFAULT_DICTIONARY) -> Column:
    """Variants, then aliases, replaced by their standard form; white space squeezed."""
    text = tx.replace_all(F.coalesce(text, F.lit("")), dictionary.variant_pairs)
    return tx.squeeze(tx.replace_all(text, dictionary.alias_pairs))


def expansions(text: Column, dictionary: TermDictionary = DEFAULT_DICTIONARY, limit: int = 8) -> Column:
    """Distinct query texts: original, normalised, then one per alias of a named entity."""

    def grow(original: Column) -> Column:
        def with_norm(norm: Column) -> Column:
            base = F.array(original, norm)
            if not dictionary.expansion_pairs:
                return base
            named = F.filter(tx.pairs(dictionary.expansion_pairs), lambda p: F.contains(norm, p["src"]))
            return F.concat(base, F.transform(named, lambda p: F.replace(norm, p["src"], p["dst"])))

        found = tx.bind(normalized(original, dictionary), with_norm)
        return F.when(original == "", F.array().cast("array<string>")).otherwise(
            F.slice(tx.distinct_clean(found), 1, max(int(limit), 1))
        )

    return tx.bind(tx.squeeze(F.coalesce(text, F.lit(""))), grow)


def index_text(text: Column, dictionary: TermDictionary = DEFAULT_DICTIONARY) -> Column:
    """Original and normalised text, once if equal; what the term index is built from."""
    return F.array_join(tx.distinct_clean(F.array(text, normalized(text, dictionary))), "\n")


def normalize_terms(queries: DataFrame, dictionary: TermDictionary = DEFAULT_DICTIONARY) -> DataFrame:
    return queries.select("query_id", normalized(F.col("text"), dictionary).alias("normalized"))


def expand_queries(queries: DataFrame, dictionary: TermDictionary = DEFAULT_DICTIONARY, limit: int = 8) -> DataFrame:
    """(query_id, …filters, variant_no, text)."""
    keep = [c for c in queries.columns if c != "text"]
    return queries.select(*keep, F.posexplode(expansions(F.col("text"), dictionary, limit)).alias("p", "text")).select(
        *keep, (F.col("p") + 1).alias("variant_no"), "text"
    )


def build_index_text(chunks: DataFrame, dictionary: TermDictionary = DEFAULT_DICTIONARY) -> DataFrame:
    return chunks.select("chunk_id", index_text(F.col("content"), dictionary).alias("index_text"))


# ------------------------------------------------------------------ search box text
def search_text(text: Column) -> Column:
    """List separators and line ends become blanks; blanks are squeezed."""
    blanked = F.translate(F.coalesce(text, F.lit("")), "\r\n，,；;、|\t", " " * 9)
    parts = F.filter(F.split(blanked, " "), lambda p: tx.strip(p) != "")
    return F.array_join(parts, " ")


def search_terms(text: Column) -> Column:
    """Distinct terms of a search text, longest first, else in order of appearance."""
    words = F.array_distinct(tx.non_empty(F.split(tx.squeeze(search_text(text)), " ")))
    keyed = F.transform(words, lambda w, i: F.struct((-F.length(w)).alias("k"), i.alias("i"), w.alias("w")))
    return F.transform(F.array_sort(keyed), lambda s: s["w"])


def html_escape(text: Column) -> Column:
    return tx.replace_all(text, [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")])


def highlighted(text: Column, terms: Column) -> Column:
    """Escaped text with each term wrapped in a mark element, longest term first."""
    marked = F.aggregate(
        F.transform(terms, html_escape),
        html_escape(text),
        lambda acc, t: F.replace(acc, t, F.concat(F.lit("<mark>"), t, F.lit("</mark>"))),
    )
    return F.when(F.coalesce(text, F.lit("")) == "", F.lit("-")).otherwise(marked)


def normalize_search_query(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", search_text(F.col("text")).alias("search_text"))


def highlight_terms(rows: DataFrame, text: str = "content", query: str = "text") -> DataFrame:
    return rows.withColumn("highlighted", highlighted(F.col(text), search_terms(F.col(query))))


# ------------------------------------------------------------------ overlap terms
_OVERLAP_SPLIT = tx.SPACE_RUN[:-2] + "，。！？；：、“”‘’\"'（）()\\[\\]{}<>《》]+"


def overlap_terms(text: Column) -> Column:
    """ASCII words, pieces between punctuation (two characters or more) and CJK bigrams."""

    def of(low: Column) -> Column:
        # Cut at what lies between: extracting all matches copies the text once per match.
        ascii_words = F.filter(F.split(low, "[^a-z0-9_]+"), lambda w: F.length(w) >= 2)
        pieces = F.filter(F.split(low, _OVERLAP_SPLIT), lambda p: F.length(p) >= 2)
        runs = F.filter(F.split(low, "[^\\u4e00-\\u9fff]+"), lambda r: F.length(r) >= 2)
        bigrams = F.flatten(F.transform(runs, lambda r: tx.char_grams(r, 2)))
        return F.array_distinct(F.concat(ascii_words, pieces, bigrams))

    return tx.bind(F.lower(F.coalesce(text, F.lit(""))), of)


def tokenize_overlap(rows: DataFrame, key: str, text: str) -> DataFrame:
    # The outer form keeps the optimizer from copying the expression into a size filter.
    terms = rows.select(key, overlap_terms(F.col(text)).alias("terms"))
    return terms.select(key, F.explode_outer("terms").alias("term")).where("term IS NOT NULL")


# ------------------------------------------------------------------ claim queries
def plain_query(text: Column) -> Column:
    """Query text without sentence marks, squeezed."""
    return tx.squeeze(F.regexp_replace(F.coalesce(text, F.lit("")), SENTENCE_MARKS, " "))


def relaxed(text: Column, lexicon: ClaimLexicon = ClaimLexicon()) -> Column:
    return plain_query(tx.drop_all(F.coalesce(text, F.lit("")), lexicon.logic_words))


def focus_topic(query: Column, lexicon: ClaimLexicon = ClaimLexicon()) -> Column:
    """First two parts longer than one character once predicate phrases are gone."""
    stripped = tx.drop_all(query, lexicon.topic_phrases)

    def pick(parts: Column) -> Column:
        longer = F.filter(parts, lambda p: F.length(p) > 1)
        two = F.when(F.size(longer) >= 2, F.slice(longer, 1, 2)).otherwise(F.slice(parts, 1, 2))
        joined = F.array_join(two, " ")
        same = joined == plain_query(query)
        return (
            F.when(F.size(parts) < 2, plain_query(stripped))
            .when(same, F.array_join(two, ""))
            .otherwise(joined)
        )

    return tx.bind(tx.non_empty(F.split(tx.squeeze(stripped), " ")), pick)


def keyword_queries(text: Column, lexicon: ClaimLexicon = ClaimLexicon()) -> Column:
    """Keyword combinations for a claim written without blanks."""
    none = F.array().cast("array<string>")
    ends = "|".join(lexicon.entity_ends)

    def of_query(query: Column) -> Column:
        rest = plain_query(tx.drop_all(query, lexicon.stop_phrases))
        relation = F.filter(tx.strings(lexicon.relation_words), lambda w: F.contains(query, w))
        entity = tx.remove_spaces(F.regexp_extract(query, f"^(.{{2,12}}?)(?:{ends})", 1)) if ends else F.lit("")

        def of_relation(rel: Column) -> Column:
            cleaned = F.transform(
                tx.non_empty(F.split(rest, " ")),
                lambda t: F.when(
                    F.length(t) >= 2,
                    tx.squeeze(F.aggregate(rel, t, lambda acc, w: F.replace(acc, w, F.lit(" ")))),
                ).otherwise(F.lit("")),
            )
            parts = F.filter(cleaned, lambda t: (F.length(t) >= 2) & ~F.array_contains(rel, t))
            # No part left: cut the text at the relation words instead.
            cut = F.aggregate(rel, rest, lambda acc, w: F.replace(acc, w, F.lit("\u0001")))
            fallback = F.when(F.size(rel) > 0, F.filter(F.split(cut, "\u0001"), lambda t: F.length(t) >= 2)).otherwise(none)

            def build(terms: Column) -> Column:
                head = F.get(terms, F.lit(0))
                tail = F.element_at(terms, -1)
                by_entity = F.when(
                    F.length(entity) >= 2,
                    F.flatten(F.transform(rel, lambda w: F.array(F.concat_ws(" ", entity, w), w))),
                ).otherwise(none)
                rest_queries = tx.non_empty(
                    F.array(
                        F.when(head != tail, F.concat_ws(" ", head, tail)).otherwise(F.lit("")),
                        tail,
                        F.when(F.size(rel) > 0, F.concat_ws(" ", head, F.get(rel, F.lit(0)))).otherwise(F.lit("")),
                    )
                )
                return F.when(F.size(terms) == 0, none).otherwise(F.concat(by_entity, rest_queries))

            return tx.bind(F.when(F.size(parts) > 0, parts).otherwise(fallback), build)

        usable = (query != "") & ~F.contains(query, F.lit(" "))
        return F.when(usable, tx.bind(relation, of_relation)).otherwise(none)

    return tx.bind(plain_query(text), of_query)


def logic_flags(text: Column, lexicon: ClaimLexicon = ClaimLexicon()) -> dict[str, Column]:
    flags = {
        "has_exclusive": tx.contains_any(text, lexicon.exclusive),
        "has_universal": tx.contains_any(text, lexicon.universal),
        "has_negation": tx.contains_any(text, lexicon.negation),
        "has_comparison": tx.contains_any(text, lexicon.comparison),
    }
    return {**flags, "is_strict": flags["has_exclusive"] | flags["has_universal"] | flags["has_negation"] | flags["has_comparison"]}


def probe(query: Column, claim: Column, lexicon: ClaimLexicon = ClaimLexicon()) -> Column:
    """For a strict claim, the query with words that look for exceptions; else empty."""
    flags = logic_flags(claim, lexicon)
    base = plain_query(query)
    with_words = lambda words: F.concat(base, F.lit(" " + words))
    return (
        F.when((base == "") | ~flags["is_strict"], F.lit(""))
        .when(flags["has_exclusive"], with_words(lexicon.probe_exclusive))
        .when(flags["has_universal"], with_words(lexicon.probe_universal))
        .when(flags["has_negation"], with_words(lexicon.probe_negation))
        .otherwise(with_words(lexicon.probe_comparison))
    )


def strip_logic_words(claims: DataFrame, lexicon: ClaimLexicon = ClaimLexicon()) -> DataFrame:
    return claims.select("claim_id", relaxed(F.col("claim_text"), lexicon).alias("relaxed"))


def topic_focus(claims: DataFrame, lexicon: ClaimLexicon = ClaimLexicon()) -> DataFrame:
    return claims.select("claim_id", focus_topic(relaxed(F.col("claim_text"), lexicon), lexicon).alias("topic"))


def keyword_focus(claims: DataFrame, lexicon: ClaimLexicon = ClaimLexicon()) -> DataFrame:
    rows = claims.select("claim_id", F.posexplode(keyword_queries(F.col("claim_text"), lexicon)).alias("p", "keyword_query"))
    return rows.select("claim_id", (F.col("p") + 1).alias("keyword_no"), "keyword_query")


def counter_probe(claims: DataFrame, lexicon: ClaimLexicon = ClaimLexicon()) -> DataFrame:
    text = F.col("claim_text")
    return claims.select("claim_id", probe(relaxed(text, lexicon), text, lexicon).alias("probe"))


def claim_queries(
    text: Column, lexicon: ClaimLexicon = ClaimLexicon(), dictionary: TermDictionary = DEFAULT_DICTIONARY
) -> Column:
    """All labelled queries of a claim, distinct by text, first label kept."""
    spec_type = "array<struct<label:string,text:string>>"
    labelled = lambda label, texts: F.transform(texts, lambda t: F.struct(F.lit(label).alias("label"), t.alias("text")))
    single = lambda label, t: labelled(label, tx.non_empty(F.array(t)))

    def of_texts(z: Column) -> Column:
        literal, loose = z["literal"], z["relaxed"]
        base = F.when(loose == "", literal).otherwise(loose)
        norm = normalized(loose, dictionary)
        sources = expansions(base, dictionary, 4)
        specs = F.concat(
            labelled("claim_literal", F.array(literal)),
            labelled("entity_expanded", F.slice(expansions(literal, dictionary, 4), 2, 4)),
            single("logic_relaxed", F.when(loose != literal, loose).otherwise(F.lit(""))),
            single("entity_expanded", F.when(norm != loose, norm).otherwise(F.lit(""))),
            single("topic_focus", focus_topic(base, lexicon)),
            labelled("keyword_focus", F.flatten(F.transform(sources, lambda s: keyword_queries(s, lexicon)))),
            labelled("keyword_focus", keyword_queries(norm, lexicon)),
            single("counter_probe", probe(base, text, lexicon)),
        )
        return F.filter(
            F.transform(specs, lambda s: F.struct(s["label"].alias("label"), tx.strip(s["text"]).alias("text"))),
            lambda s: s["text"] != "",
        ).cast(spec_type)

    def first_by_text(specs: Column) -> Column:
        texts = F.transform(specs, lambda s: s["text"])
        return F.filter(specs, lambda s, i: F.array_position(texts, s["text"]) == i + 1)

    both = F.struct(tx.strip(text).alias("literal"), relaxed(text, lexicon).alias("relaxed"))
    return tx.bind(tx.bind(both, of_texts), first_by_text)


def build_retrieval_queries(
    claims: DataFrame, lexicon: ClaimLexicon = ClaimLexicon(), dictionary: TermDictionary = DEFAULT_DICTIONARY
) -> DataFrame:
    """(claim_id, query_no, label, text)."""
    keep = [c for c in ("claim_id", "doc_uid", "knowledge_base_id") if c in claims.columns]
    rows = claims.select(*keep, F.posexplode(claim_queries(F.col("claim_text"), lexicon, dictionary)).alias("p", "q"))
    return rows.select(*keep, (F.col("p") + 1).alias("query_no"), "q.label", "q.text")


# ------------------------------------------------------------------ question terms
def is_generic_tree(term: Column, lexicon: QuestionLexicon) -> Column:
    def test(n: Column) -> Column:
        short_noise = F.lit(False)
        for p in lexicon.noisy_prefixes:
            short_noise = short_noise | F.startswith(n, F.lit(p))
        for s in lexicon.noisy_suffixes:
            short_noise = short_noise | F.endswith(n, F.lit(s))
        return (F.length(n) < 2) | n.isin(*lexicon.generic_tree) | ((F.length(n) <= 4) & short_noise)

    return tx.bind(compact(term), test)


def is_generic_chunk(term: Column, lexicon: QuestionLexicon) -> Column:
    def test(n: Column) -> Column:
        rest = F.replace(n, F.lit(lexicon.subject))
        return (
            (F.length(n) > lexicon.max_chunk_term)
            | F.contains(n, F.lit(lexicon.particle))
            | F.startswith(n, F.lit(lexicon.chunk_prefix))
            | tx.contains_any(n, lexicon.noisy_chunk)
            | n.isin(*lexicon.generic_chunk)
            | (rest == "")
            | rest.isin(*lexicon.generic_chunk)
        )

    return tx.bind(compact(term), test)


def meaningful(segment: Column, lexicon: QuestionLexicon) -> Column:
    """A segment and the phrases it implies, without generic terms."""
    found = F.array(segment)
    for phrase, extra, shortest in lexicon.expansions:
        applies = F.contains(segment, F.lit(phrase)) & (F.length(segment) >= shortest)
        found = F.concat(found, F.when(applies, tx.strings(extra)).otherwise(F.array().cast("array<string>")))
    return F.filter(found, lambda t: ~is_generic_tree(t, lexicon))


def question_terms(question: Column, lexicon: QuestionLexicon = QuestionLexicon()) -> Column:
    """Content terms of a question, at most 24 where it is cut from an unspaced text."""
    none = F.array().cast("array<string>")
    compacted = F.regexp_replace(question, "[，。！？、,.?？\\s\\x1c-\\x1f\\x85\\xa0\\u3000]", "")

    def of_spaced(terms: Column) -> Column:
        def of_compact(flat: Column) -> Column:
            whole = (F.size(terms) == 1) & (F.get(terms, F.lit(0)) == flat) & tx.contains_any(flat, lexicon.compact_markers)
            first = F.when(whole, none).otherwise(terms)
            subject = F.when(F.contains(flat, F.lit(lexicon.subject)), F.array(F.lit(lexicon.subject))).otherwise(none)
            segments = F.filter(
                F.split(tx.squeeze(tx.drop_all(flat, lexicon.cut_phrases)), " "), lambda s: F.length(s) >= 2
            )
            more = F.flatten(F.transform(segments, lambda s: meaningful(s, lexicon)))
            start = F.concat(first, subject)
            fresh = F.array_except(F.array_distinct(more), start)
            return F.slice(F.concat(start, fresh), 1, 24)

        return F.when(F.size(terms) > 1, terms).otherwise(tx.bind(compacted, of_compact))

    spaced = F.filter(F.split(tx.squeeze(F.translate(question, "，？?", "   ")), " "), lambda t: F.length(t) >= 2)
    return tx.bind(spaced, of_spaced)


def _longest_first(terms: Column, limit: int) -> Column:
    keyed = F.transform(terms, lambda t, i: F.struct((-F.length(t)).alias("k"), i.alias("i"), t.alias("t")))
    return F.slice(F.transform(F.array_sort(keyed), lambda s: s["t"]), 1, limit)


def tree_terms(terms: Column, lexicon: QuestionLexicon = QuestionLexicon(), limit: int = 16) -> Column:
    """Terms for scoring sections: generic ones dropped, longest first."""
    cleaned = F.array_distinct(tx.non_empty(F.transform(terms, tx.strip)))
    return _longest_first(F.filter(cleaned, lambda t: ~is_generic_tree(t, lexicon)), limit)


def chunk_terms(
    terms: Column,
    question: Column,
    lexicon: QuestionLexicon = QuestionLexicon(),
    dictionary: TermDictionary = DEFAULT_DICTIONARY,
    limit: int = 8,
) -> Column:
    """Terms for chunk supplements: expanded, tied to the question, generic ones dropped."""

    def per_term(term: Column, flat: Column) -> Column:
        split_up = F.flatten(F.transform(expansions(term, dictionary, 8), lambda e: F.split(e, " ")))
        wide = F.when(is_generic_chunk(term, lexicon), F.array(term)).otherwise(
            F.array_distinct(F.concat(F.array(term), tx.non_empty(split_up)))
        )
        candidates = F.array_distinct(F.concat(wide, meaningful(term, lexicon)))
        return F.filter(
            candidates,
            lambda e: (F.contains(flat, compact(term)) | F.contains(flat, compact(e))) & ~is_generic_chunk(e, lexicon),
        )

    cleaned = F.array_distinct(tx.non_empty(F.transform(terms, tx.strip)))
    none = F.array().cast("array<string>")
    # A term that an earlier one already brought in is not expanded again.
    grow = lambda flat: F.aggregate(
        cleaned,
        none,
        lambda acc, t: F.when(F.array_contains(acc, t), acc).otherwise(F.array_union(acc, per_term(t, flat))),
    )
    return _longest_first(tx.bind(compact(question), grow), limit)


def extract_question_terms(questions: DataFrame, lexicon: QuestionLexicon = QuestionLexicon()) -> DataFrame:
    rows = questions.select("question_id", F.posexplode(question_terms(F.col("question"), lexicon)).alias("p", "term"))
    return rows.select("question_id", (F.col("p") + 1).alias("term_no"), "term")


def filter_generic_terms(
    questions: DataFrame,
    lexicon: QuestionLexicon = QuestionLexicon(),
    dictionary: TermDictionary = DEFAULT_DICTIONARY,
) -> DataFrame:
    """(question_id, purpose, term_no, term) for purpose ``tree`` and ``chunk``."""
    question = F.col("question")
    terms = F.col("terms")
    both = questions.select("question_id", "question", question_terms(question, lexicon).alias("terms"))
    tagged = F.array(
        F.struct(F.lit("tree").alias("purpose"), tree_terms(terms, lexicon).alias("terms")),
        F.struct(F.lit("chunk").alias("purpose"), chunk_terms(terms, question, lexicon, dictionary).alias("terms")),
    )
    rows = both.select("question_id", F.explode(tagged).alias("t")).select(
        "question_id", "t.purpose", F.posexplode("t.terms").alias("p", "term")
    )
    return rows.select("question_id", "purpose", (F.col("p") + 1).alias("term_no"), "term")
