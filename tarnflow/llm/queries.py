"""One query for each operator of this subpackage, over whole tables; and the pipeline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnflow.llm import exact_dedup, filter_audit, fim, language_id, mixing, ngram_join, packing, quality_rules, sharding, substring_dedup, token_counts, twins, url_filter, vector_dedup
from tarnflow.llm.shared import save, text_batches


#: Bytes of text that these queries encode at once: more than in the pipeline, whose executors have less memory to spare.
AT_ONCE = 4_000_000


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's sentences, which of them repeat an earlier place, and the text without them. Null text stays null."""
    out = substring_dedup.substring_dedup(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_sentences", "n_removed", F.array_join(F.transform("removed", lambda i: i.cast("string")), ",").alias("removed"), "kept_text")


def op2_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 39 of near equal bytes. Null text is empty."""
    return sharding.shard(_table(spark, sf_dir, "documents"), 40)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece's place in a sequence of at most 2048 tokens. Null text is empty: one end id."""
    return packing.pack(_table(spark, sf_dir, "documents"), tokens=2048, at_once=AT_ONCE)


def op4_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language, score and mixture of every document, by a model fitted on documents that aren't held out. Null text is "und"."""
    docs = _table(spark, sf_dir, "documents")
    model = language_id.fit(docs.where(~language_id.held_out(F.col("doc_id"))))
    return language_id.predict(docs, model).select("doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "languages")


def op5_fuse_filter_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The older half of the ids is the snapshot, the other one the new batch."""
    docs = _table(spark, sf_dir, "documents")
    half = docs.agg(F.percentile_approx("doc_id", 0.5)).first()[0] or 0
    old = F.coalesce(F.col("doc_id") <= half, F.lit(True))
    out = exact_dedup.exact_dedup(docs.where(~old), docs.where(old))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


#: Target weights of languages, sources and topics; "*": of every value that isn't named.
WEIGHTS = {"lang": {"en": 4.0, "de": 2.0, "fr": 2.0, "es": 2.0, "*": 1.0}, "source": {"*": 1.0}, "mix_topic": {"*": 1.0}}


def op6_raked_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's calibrated weight, probability and draw. Null texts have no tokens and are never drawn; null languages and sources are values of their own."""
    docs = _table(spark, sf_dir, "documents")
    rows = save(mixing.profiled(docs, None, keep=["doc_id", "source", "lang"], at_once=AT_ONCE), "profiles")
    out = mixing.mix(mixing.topical(rows, mixing.fit_marks(rows)), ["source", "lang", "mix_topic"], F.col("mix_tokens"), keep=0.5, given=WEIGHTS)
    names = {"mix_topic": "topic", "mix_tokens": "tokens", "mix_weight": "weight", "mix_prob": "prob", "mix_keep": "kept", "mix_gap": "gap"}
    return out.withColumnsRenamed(names).select("doc_id", "source", "lang", *names.values())


#: Rules (host, path, verdict).
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
#: The listed urls: pages of these sites under these domains and languages, numbered below LISTED_PAGES and not divisible by 3.
LISTED_SITES, LISTED_DOMAINS, LISTED_LANGS, LISTED_PAGES = ("spam-farm", "cheap-pills", "adult-x"), ("example.com", "example.net"), ("en", "de", "fr", "es"), 1_000


def listed_urls(spark: SparkSession) -> DataFrame:
    """Canonical keys of the listed urls; they don't depend on any table. Two pages of three of each site are on the list, so its neighbours are near misses."""
    each = lambda values: F.explode(F.array(*map(F.lit, values)))
    rows = spark.range(LISTED_PAGES).where("id % 3 <> 0").withColumn("site", each(LISTED_SITES)).withColumn("domain", each(LISTED_DOMAINS)).withColumn("lang", each(LISTED_LANGS))
    return rows.select(F.format_string("%s.%s/%s/%d", "site", "domain", "lang", "id").alias("key"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page; without a rule, urls on the list are blocked and all others allowed."""
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return url_filter.url_filter(_table(spark, sf_dir, "pages"), rules, listed_urls(spark))


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of every document's set of five-word shingles, and its component. Null text has an empty set."""
    return ngram_join.near_duplicates(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def edits(doc_id, text) -> Column:
    """Three edits of a document: a word put in, a stretch taken out, one replaced; at places drawn by its id."""
    at = lambda k: F.pmod(F.xxhash64(doc_id, F.lit(k)), F.coalesce(F.length(text), F.lit(0)) + 1)
    one = lambda k, n, new: F.struct(at(k).alias("start"), (at(k) + n).alias("stop"), F.lit(new).alias("text"))
    return F.array(one(1, 0, "inserted "), one(2, 40, ""), one(3, 12, " another few words"))


def op9_edit_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document before and after its edits. The trees are built and stored first; the edits then start from what is stored. A null text counts as empty."""
    trees = save(token_counts.token_trees(_table(spark, sf_dir, "documents"), keep=True), "trees", compression="zstd")
    out = token_counts.apply_edits(trees.withColumn("edits", edits(F.col("doc_id"), F.col("text"))), trees=("leaf_chars", "leaf_tokens"))
    return out.select("doc_id", "tokens_before", "tokens_after", "encoded_chars", "text_crc32", F.size("leaf_chars").alias("leaves"))


def op10_pq_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector. Null and zero vectors link with nothing."""
    return vector_dedup.near_vectors(_table(spark, sf_dir, "embeddings"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units, form and cuts of every document, with digests of its output and of the text rebuilt from that. Null text is empty: a plain one."""
    out = fim.fill_in_middle(_table(spark, sf_dir, "documents"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(fim.restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove in all 120 orders, for each language. Null text is empty, a null language the empty string."""
    return filter_audit.filter_audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of every document and the verdict of the base rule and of rules learned from its labels. Null text has no words."""
    out = quality_rules.quality_rules(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows of corpus_pipeline. Nulls, empty texts and tables, repeated rows and other columns go through as each stage's docstring says."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_substring_dedup, op2_sampled_splitters, op3_best_fit_packing, op4_language_mixture, op5_fuse_filter_dedup, op6_raked_mixture, op7_url_filter, op8_ngram_jaccard, op9_edit_token_counts, op10_pq_near_vectors, op11_fill_in_middle, op12_filter_audit, op13_quality_rules, pipeline)}

#: Tokens, trained models, samples and packings are beyond SQL: op2, op3, op4, op6, op9, op13 and the pipeline have tests instead.
ORACLE_SQL: dict[str, str] = twins.ORACLE_SQL
