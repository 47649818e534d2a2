"""The query catalogue on the test tables. Every query reads whole tables and whole texts."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from feedlens.constants import CLUSTER_DISTANCE, CLUSTER_SWEEP, DEDUP_SWEEP
from feedlens.functions import text as T
from feedlens.functions.text import embedding_text
from feedlens.functions import vectors as V
from feedlens.operators import calibrate, cluster, components, decide, dedup, dense_encoder, encode, evaluate, fingerprint, impact_index, merge_forest, pairs, prompt, resample, retrieve, score
from feedlens.operators.dedup_store import DedupStore
from feedlens.operators.prediction_log import PredictionLog
from feedlens.operators.vector_store import VectorStore
from feedlens.plans import pipelines, tables
from feedlens.session import materialise, work_folder
from feedlens.sources import adapters, exports, files, sinks

GATES = [0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5]


def _text_edges(encoder):
    """Similarity edges of ticket vectors, as a spanning forest."""

    def edges(vectors: DataFrame, threshold: float) -> DataFrame:
        return pairs.sparse_pairs(vectors, encoder, threshold, forest=True)

    return edges


def _joined(c: str):
    return F.array_join(F.col(c), " / ").alias(c)


# --- ingest --------------------------------------------------------------------------


def q_normalize_tickets(spark: SparkSession, sf: str) -> DataFrame:
    raw = tables.table(spark, sf, "conversations").drop("role")
    return files.normalize(raw, order=["conv_id", "turn"]).select("ticket_id", "created_at", "topic", "message")


def q_adapt_support_tickets(spark: SparkSession, sf: str) -> DataFrame:
    raw = tables.table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("tweet_id"), F.col("source").alias("category"), F.col("text")
    )
    return adapters.support_tickets(raw).select("ticket_id", "created_at", "topic", F.md5("message").alias("message_md5"))


def q_adapt_app_reviews(spark: SparkSession, sf: str) -> DataFrame:
    raw = tables.table(spark, sf, "labels").join(tables.table(spark, sf, "documents"), "doc_id").select(
        F.col("doc_id").cast("string").alias("reviewId"), (F.col("quality") * 4 + 1).cast("string").alias("score"),
        F.col("text").alias("content"), F.lit(None).cast("string").alias("at"),
    )
    return adapters.app_reviews(raw).select("ticket_id", "created_at", "topic", F.md5("message").alias("message_md5"))


def q_event_properties(spark: SparkSession, sf: str) -> DataFrame:
    """Records inside JSON texts, flattened by key."""
    events = tables.table(spark, sf, "events").select("event_id", F.try_parse_json("props").alias("record"))
    entries = files.record_entries(events, ["event_id"])
    return entries.groupBy("key").agg(F.count("*").alias("n"), F.count_distinct("value").alias("distinct_values"))


def _as_record(df: DataFrame, **fields) -> DataFrame:
    """Rows as parsed JSON records, as an export's page holds them."""
    return df.withColumn("record", F.parse_json(F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()]))))


def q_adapt_issues(spark: SparkSession, sf: str) -> DataFrame:
    raw = tables.table(spark, sf, "documents").select(F.col("doc_id").alias("number"), F.col("source").alias("title"), F.col("text").alias("body"))
    return adapters.issues(raw).select("ticket_id", "created_at", "topic", F.md5("message").alias("message_md5"))


def q_adapt_product_reviews(spark: SparkSession, sf: str) -> DataFrame:
    raw = tables.table(spark, sf, "documents").select(
        F.col("source").alias("reviewerID"), F.col("doc_id").cast("string").alias("asin"), F.col("lang").alias("summary"), F.col("text").alias("reviewText")
    )
    return adapters.product_reviews(raw).select("ticket_id", "created_at", "topic", F.md5("message").alias("message_md5"))


def q_export_support_desk(spark: SparkSession, sf: str) -> DataFrame:
    docs = tables.table(spark, sf, "documents")
    records = _as_record(docs, id=F.col("doc_id"), created_at=F.lit("2024-05-01T00:00:00Z"), subject=F.col("lang"), description=F.col("text"))
    found = exports.support_desk(records.select("record"))
    return found.select("ticket_id", "created_at", "topic", F.md5("message").alias("message_md5"))


def q_export_conversations(spark: SparkSession, sf: str) -> DataFrame:
    """Every other turn has no subject of its own and takes the title."""
    turns = tables.table(spark, sf, "conversations")
    subject = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("about "), "role")).otherwise(F.lit(""))
    id = F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    records = _as_record(turns, id=id, title=F.col("role"), source=F.struct(subject.alias("subject"), F.col("text").alias("body")))
    found = exports.conversations(records.select("record"))
    return found.select("ticket_id", "topic", F.md5("message").alias("message_md5"))


def q_export_page_properties(spark: SparkSession, sf: str) -> DataFrame:
    def tagged(kind: str, value) -> Column:
        return F.struct(F.lit(kind).alias("type"), value.alias(kind))

    def text(value) -> Column:
        return F.array(F.struct(value.alias("plain_text")))

    size = F.length("html")
    tags = F.array(F.struct(F.lit("page").alias("name")), F.struct((F.col("page_id") % 3).cast("string").alias("name")))
    properties = F.struct(
        tagged("title", text(F.col("url"))).alias("Name"), tagged("number", size).alias("Size"), tagged("multi_select", tags).alias("Tags"),
        tagged("checkbox", F.col("page_id") % 2 == 0).alias("Done"), tagged("select", F.struct(F.lit("web").alias("name"))).alias("Kind"),
        tagged("rich_text", text(F.col("html"))).alias("Body"),
    )
    records = _as_record(tables.table(spark, sf, "pages"), id=F.col("page_id").cast("string"), properties=properties)
    found = exports.page_properties(records.select("record"))
    return found.select(F.col("_page_id").alias("page_id"), "Name", "Size", "Tags", "Done", "Kind", F.md5("Body").alias("body_md5"))


def q_wrapped_records(spark: SparkSession, sf: str) -> DataFrame:
    """Records in a wrapper object, in a list and alone, one JSON document per conversation."""
    turns = tables.table(spark, sf, "conversations")
    listed = F.array_sort(F.collect_list(F.struct("turn", "role", F.md5("text").alias("text"))))
    whole = turns.groupBy("conv_id").agg(listed.alias("tickets"))
    kind = F.col("conv_id") % 3
    wrapped = F.to_json(F.struct("tickets"))
    document = F.when(kind == 0, wrapped).when(kind == 1, F.to_json("tickets")).otherwise(F.to_json(F.element_at("tickets", 1)))
    records = whole.select("conv_id", F.posexplode(files.extract_records(F.parse_json(document))).alias("at", "record"))
    return files.record_entries(records, ["conv_id", "at"]).withColumn("at", F.col("at").cast("bigint"))


def _paged_json(rows: DataFrame, id: str, key: str, path: str, page_rows: int = 500) -> None:
    """One JSON document ``{key: [records]}`` per file, as an export lands its pages."""
    record = F.struct(*[c for c in rows.columns if c != id], F.col(id).cast("string").alias(id))
    pages = rows.groupBy(F.floor(F.col(id) / page_rows).alias("page")).agg(F.collect_list(record).alias(key))
    sinks.write_table(pages.repartition("page"), path, format="json", partition_by=["page"])


def _csv(rows: DataFrame, path: str) -> None:
    rows.write.option("escape", '"').csv(path, header=True)


def _landed(part: str, tickets: DataFrame, id=None) -> DataFrame:
    return tickets.select(F.lit(part).alias("part"), (F.col("ticket_id") if id is None else id).alias("ticket_id"), "topic", F.md5("message").alias("message_md5"))


def q_landed_exports(spark: SparkSession, sf: str) -> DataFrame:
    """Documents landed as pages of a support desk and as a sheet, read back as tickets."""
    place, docs = work_folder(spark, "landed"), tables.table(spark, sf, "documents")
    _paged_json(docs.select(F.col("doc_id").alias("id"), F.col("lang").alias("subject"), F.col("text").alias("description")), "id", "tickets", f"{place}/desk")
    _csv(docs.select(F.col("doc_id").alias("ticket_id"), F.col("source").alias("topic"), F.col("text").alias("message")), f"{place}/sheet")
    desk = exports.load_export(spark, "zendesk", f"{place}/desk")
    return _landed("desk", desk).unionByName(_landed("sheet", exports.load_export(spark, "google_sheets", f"{place}/sheet")))


def q_landed_files(spark: SparkSession, sf: str) -> DataFrame:
    """A folder of CSV, JSON and text files read by extension; line numbers of text files are left out, as files are split freely."""
    place, turns = work_folder(spark, "landed"), tables.table(spark, sf, "conversations")
    turns = turns.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("role").alias("topic"), F.col("text").alias("message"))
    _csv(turns.where("id % 2 = 1"), f"{place}/csv")
    _paged_json(turns.where("id % 2 = 0"), "id", "tickets", f"{place}/json", 50_000)
    lines = tables.table(spark, sf, "benchmark").select(F.regexp_replace("text", "[\\r\\n]+", " ").alias("value"))
    lines.where("value is not null").write.text(f"{place}/txt")
    found = files.read_feedback(spark, place)
    kind = F.regexp_extract("source_file", r"\.(\w+)$", 1)
    return _landed("files", found, F.when(kind != "txt", F.col("ticket_id")))


def q_landed_datasets(spark: SparkSession, sf: str) -> DataFrame:
    """Two datasets of a registry file, one in CSV and one in JSON, through their adapters into one table."""
    place, docs = work_folder(spark, "landed"), tables.table(spark, sf, "documents")
    _csv(docs.select(F.col("doc_id").alias("tweet_id"), F.col("source").alias("category"), "text"), f"{place}/support")
    _paged_json(docs.select(F.col("doc_id").alias("number"), F.col("lang").alias("title"), F.col("text").alias("body")), "number", "items", f"{place}/issues")
    known = [
        {"name": "support", "path": f"{place}/support", "format": "csv", "adapter": "CustomerSupportAdapter"},
        {"name": "issues", "path": f"{place}/issues", "format": "json", "adapter": "GitHubIssuesAdapter"},
    ]
    spark.createDataFrame([(json.dumps({"datasets": known}),)], "value string").coalesce(1).write.text(f"{place}/registry")
    found = adapters.load_datasets(spark, f"{place}/registry")
    numbered = found.agg(F.count_distinct("pos").alias("positions"))
    rows = found.select("dataset", "ticket_id", "created_at", "topic", F.md5("message").alias("message_md5"))
    return rows.crossJoin(F.broadcast(numbered))  # one row


def q_parse_time(spark: SparkSession, sf: str) -> DataFrame:
    """Event times written in six text forms and read back; one form is no date."""
    ts, form = F.date_trunc("second", "ts"), F.col("event_id") % 6
    written = (
        F.when(form == 0, F.date_format(ts, "yyyy-MM-dd HH:mm:ss")).when(form == 1, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .when(form == 2, F.date_format(ts, " yyyy-MM-dd ")).when(form == 3, F.unix_timestamp(ts).cast("string"))
        .when(form == 4, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss+02:00")).otherwise(F.concat(F.lit("on "), ts.cast("string")))
    )
    events = tables.table(spark, sf, "events").select("event_id", form.alias("form"), T.parse_time(written).alias("parsed"))
    return events.select("event_id", F.unix_timestamp("parsed").alias("seconds"))


# --- exact duplicates ------------------------------------------------------------------


def q_exact_key_groups(spark: SparkSession, sf: str) -> DataFrame:
    keyed = dedup.exact_components(tables.tickets(spark, sf))
    return keyed.groupBy("component").agg(F.count("*").alias("group_size"), F.max("pos").alias("last_pos")).where("group_size > 1")


def _exact_members(spark, sf, strategy: str, with_dates: bool = False) -> DataFrame:
    rows = dedup.exact_components(tables.tickets(spark, sf))
    if with_dates:
        rows = rows.join(tables.dates(spark, sf), "pos", "left")
    return dedup.choose_representatives(rows, strategy)


def q_exact_dedup_longest(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.duplicate_groups(_exact_members(spark, sf, "longest"))


def q_exact_dedup_earliest(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.duplicate_groups(_exact_members(spark, sf, "earliest", with_dates=True))


def q_exact_dedup_stats(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.dedup_stats(_exact_members(spark, sf, "longest"), ("topic",))


def q_md5_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    """Order-free fingerprint of the tickets of each topic: the sum of both halves of their digests, so copies count."""
    digest = T.row_fingerprint(F.col("topic"), F.col("message"))
    halves = [F.conv(F.substring(digest, at, 16), 16, 10).cast("decimal(20,0)") for at in (1, 17)]
    total = F.sum(halves[0].cast("decimal(28,0)") + halves[1])
    return tables.tickets(spark, sf).groupBy("topic").agg(F.count("*").alias("tickets"), total.cast("string").alias("fingerprint"))


def q_ordered_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    """Order-sensitive fingerprint of all tickets by position."""
    return fingerprint.ordered_fingerprint(tables.tickets(spark, sf), embedding_text(F.col("topic"), F.col("message")), ["pos"])


def q_incremental_embed_anti(spark: SparkSession, sf: str) -> DataFrame:
    """Texts still to be embedded when the labelled documents are already in the store."""
    rows = tables.tickets(spark, sf)
    text = T.embedding_text(F.col("topic"), F.col("message"))
    known = rows.join(tables.table(spark, sf, "labels").select(F.col("doc_id").alias("pos")), "pos", "left_semi")
    store = encode.with_text_hash(known, "tf-idf", text).select("model", "text_hash")
    return encode.missing_from_store(rows, store, "tf-idf", text).select("model", "text_hash", F.length("text").cast("bigint").alias("chars"))


def q_store_growth(spark: SparkSession, sf: str) -> DataFrame:
    """Texts of benchmark, conversations and documents put into one store in turn: what each batch adds, and vectors found."""
    encoder = tables.encoder(spark, sf)
    path = work_folder(spark, "vector-store")
    store = VectorStore(spark, path.rsplit("/", 1)[-1].replace("-", "_"), path, f"vec {V.SPARSE}")
    out, before = None, 0
    for number, name in enumerate(["benchmark", "conversations", "documents"], 1):
        rows = tables.table(spark, sf, name).select("text")
        store.extend(rows, lambda fresh: encoder.encode(fresh, F.col("text"), "vec"), F.col("text"))
        after = store.table().count()
        found = store.attach(rows, F.col("text")).agg(F.count("*").alias("rows"), F.count("vec").alias("with_vector"))
        step = found.select(F.lit(number).cast("bigint").alias("batch"), F.lit(after - before).cast("bigint").alias("embedded"), F.lit(after).cast("bigint").alias("stored"), "rows", "with_vector")
        out, before = step if out is None else out.unionByName(step), after
    return out


# --- retrieval -------------------------------------------------------------------------


def q_vector_norm_audit(spark: SparkSession, sf: str) -> DataFrame:
    return encode.norm_audit(tables.vectors(spark, sf), "vec")


def _centroids(spark, sf) -> DataFrame:
    sums = cluster.vector_sums(tables.vectors(spark, sf), ["label"], "vec")
    unit = F.transform("total", lambda x: x / V.norm(F.col("total")))
    return sums.select(F.col("label").alias("proposal_id"), unit.alias("query_vec"))


def q_topk_vectors(spark: SparkSession, sf: str) -> DataFrame:
    found = retrieve.retrieve(_centroids(spark, sf), tables.vectors(spark, sf), 5, 0.2)
    return found.select("proposal_id", F.col("rank").cast("bigint").alias("rank"), "ticket_id", F.round("similarity", 6).alias("similarity"))


def _text_evidence(spark, sf, k: int = 5) -> tuple[DataFrame, DataFrame]:
    proposals, tickets, _ = tables.encoded(spark, sf)
    return proposals, retrieve.retrieve(proposals, tickets, k, 0.2)


def q_tfidf_topk(spark: SparkSession, sf: str) -> DataFrame:
    _, found = _text_evidence(spark, sf)
    return found.select("proposal_id", F.col("rank").cast("bigint").alias("rank"), "ticket_id", F.round("similarity", 6).alias("similarity"))


def _indexed(spark, sf) -> tuple[DataFrame, DataFrame, impact_index.IndexedTopK]:
    proposals, tickets, _ = tables.encoded(spark, sf)
    return proposals, tickets, impact_index.indexed_top_k(proposals, impact_index.build_index(tickets))


def q_indexed_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The tickets of ``q_tfidf_topk``, found through the index."""
    _, tickets, found = _indexed(spark, sf)
    rows = found.rows.join(tickets.select("pos", "ticket_id"), "pos")
    return rows.select("proposal_id", F.col("rank").cast("bigint").alias("rank"), "ticket_id", F.round("similarity", 6).alias("similarity"))


def q_index_work(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks and tickets that the index looked at per proposal, beside all tickets."""
    proposals, tickets, found = _indexed(spark, sf)
    total = tickets.where("vec is not null").agg(F.count("*").alias("tickets"))
    rows = proposals.select("proposal_id").join(found.work, "proposal_id", "left").crossJoin(F.broadcast(total))  # one row
    return rows.select("proposal_id", F.coalesce("blocks", F.lit(0)).alias("blocks"), F.coalesce("scored", F.lit(0)).alias("scored"), "tickets")


def q_gate_counts(spark: SparkSession, sf: str) -> DataFrame:
    proposals, found = _text_evidence(spark, sf)
    return retrieve.gate_counts(proposals, found, tables.TEXT_GATE)


def q_similar_pairs_vectors(spark: SparkSession, sf: str) -> DataFrame:
    found = pairs.dense_pairs(tables.vectors(spark, sf), tables.VECTOR_THRESHOLD, vec="vec")
    return found.select("a", "b", F.round("similarity", 6).alias("similarity"))


# --- annotated pairs -------------------------------------------------------------------


def _pair_texts(spark, sf) -> DataFrame:
    return evaluate.annotate_pairs(tables.annotated_pairs(spark, sf), tables.tickets(spark, sf), ["topic", "message"])


def q_jaccard_pairs(spark: SparkSession, sf: str) -> DataFrame:
    both = _pair_texts(spark, sf)
    return both.select("ticket_a", "ticket_b", F.round(T.token_jaccard(F.col("message_a"), F.col("message_b")), 6).alias("jaccard"))


def q_trigram_pairs(spark: SparkSession, sf: str) -> DataFrame:
    both = _pair_texts(spark, sf)
    return both.select("ticket_a", "ticket_b", F.round(T.ngram_jaccard(F.col("message_a"), F.col("message_b")), 6).alias("trigram"))


# --- semantic duplicates -----------------------------------------------------------------


def _semantic_members(spark, sf, strategy: str = "longest") -> DataFrame:
    fitted = tables.encoder(spark, sf)
    rows = dedup.corpus_components(tables.tickets(spark, sf), _text_edges(fitted), encode=lambda t: pipelines.encode_tickets(t, fitted))
    return dedup.choose_representatives(rows, strategy)


def q_incremental_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Components of all documents, added to a store in three batches."""
    rows = tables.tickets(spark, sf)
    store = DedupStore(spark, work_folder(spark, "dedup"), tables.encoder(spark, sf))
    last = rows.agg(F.max("pos")).first()[0] or 0
    for third in range(3):
        store.add(rows.where(F.floor(F.col("pos") * 3 / (last + 1)) == third))
    return store.components()


def q_components(spark: SparkSession, sf: str) -> DataFrame:
    """Components of the graph of similar vectors."""
    edges = pairs.dense_pairs(tables.vectors(spark, sf), tables.VECTOR_THRESHOLD, vec="vec", forest=True)
    return components.connected_components(edges)


def q_semantic_dedup_stats(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.dedup_stats(_semantic_members(spark, sf))


def q_semantic_dedup_groups(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.duplicate_groups(_semantic_members(spark, sf))


# --- clusters ------------------------------------------------------------------------------


def q_cluster_medoid(spark: SparkSession, sf: str) -> DataFrame:
    found = cluster.medoids(tables.vectors(spark, sf), ["label"], vec="vec")
    return found.select("label", "size", "representative_id", F.round("centrality", 6).alias("centrality"))


def q_cluster_cohesion(spark: SparkSession, sf: str) -> DataFrame:
    found = cluster.cohesion(tables.vectors(spark, sf), ["label"], "vec")
    return found.select("label", "size", F.round("cohesion", 6).alias("cohesion"))


def q_cluster_stats(spark: SparkSession, sf: str) -> DataFrame:
    sizes = tables.vectors(spark, sf).groupBy(F.col("label").alias("cluster_id")).agg(F.count("*").alias("size"))
    counts = F.map_values("cluster_distribution")
    return cluster.cluster_stats(sizes, ()).select(
        "total_clusters", "average_cluster_size", F.array_max(counts).alias("largest"), F.array_min(counts).alias("smallest")
    )


def q_avg_link_clusters(spark: SparkSession, sf: str) -> DataFrame:
    return cluster.cluster_corpus(tables.vectors(spark, sf), 1.0 - tables.VECTOR_THRESHOLD, vec="vec")


def q_silhouette(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.cluster_quality(tables.vectors(spark, sf), "label", "vec")


# --- scores and decisions ----------------------------------------------------------------------


def _evidence_run(spark, sf) -> pipelines.EvidenceRun:
    proposals, tickets, _ = tables.encoded(spark, sf)
    return pipelines.evidence_pipeline(proposals, tickets, evidence_threshold=tables.TEXT_GATE, dates=tables.dates(spark, sf))


def _decision_run(spark, sf) -> pipelines.DecisionRun:
    proposals, tickets, _ = tables.encoded(spark, sf)
    return pipelines.decision_pipeline(proposals, tickets, evidence_threshold=tables.TEXT_GATE, dates=tables.dates(spark, sf))


def q_evidence_factors(spark: SparkSession, sf: str) -> DataFrame:
    run = _evidence_run(spark, sf)
    factors = [F.round(c, 6).alias(c) for c in score.FACTORS]
    return score.factor_points(run.validated).select("proposal_id", "n", F.round("mean_similarity", 6).alias("mean_similarity"), *factors)


def q_evidence_score(spark: SparkSession, sf: str) -> DataFrame:
    run = _evidence_run(spark, sf)
    return run.scores.select("proposal_id", F.col("score").cast("bigint").alias("score"), "confidence", "evidence_summary.*", "factors.*")


def q_evidence_prompt(spark: SparkSession, sf: str) -> DataFrame:
    run = _evidence_run(spark, sf)
    return run.prompts.select("proposal_id", F.md5("prompt").alias("prompt_md5"), F.length("prompt").cast("bigint").alias("chars"))


def _scored_documents(spark, sf) -> DataFrame:
    """Every document as a proposal of its own, with a score from its length and cycled criteria."""
    docs = tables.table(spark, sf, "documents")
    return docs.select(
        F.col("doc_id").alias("proposal_id"), (F.col("n_chars") % 101).alias("evidence_score"),
        *[tables.criterion(F.col("doc_id") + F.col("n_chars") * (s + 1), s).alias(c) for c, s in tables.OFFSETS.items()],
        score.sample_size(F.col("n_chars") % 8).alias("sample_size"), (F.col("n_chars") % 3).alias("duplicate_count"),
    )


def q_decision(spark: SparkSession, sf: str) -> DataFrame:
    made = decide.decide(_scored_documents(spark, sf))
    return made.select(
        "proposal_id", "recommendation", F.col("priority_score").cast("bigint").alias("priority_score"), "decision_tier",
        F.round("criteria_breakdown.raw_benefits", 6).alias("raw_benefits"),
        F.round("criteria_breakdown.raw_frictions", 6).alias("raw_frictions"),
    )


def q_decision_tiers(spark: SparkSession, sf: str) -> DataFrame:
    made = decide.decide(_scored_documents(spark, sf))
    return made.groupBy("recommendation", "decision_tier").agg(F.count("*").alias("proposals"))


def q_decision_arrays(spark: SparkSession, sf: str) -> DataFrame:
    made = decide.decide(_scored_documents(spark, sf))
    return made.select("proposal_id", *[_joined(c) for c in ("rationale", "assumptions", "risks", "trade_offs", "missing_information")])


def q_decision_pipeline(spark: SparkSession, sf: str) -> DataFrame:
    run = _decision_run(spark, sf)
    stats = run.dedup_stats.select("proposal_id", "total_input_count", "unique_count", "exact_duplicates_count", "semantic_duplicates_count")
    made = run.decisions.select(
        "proposal_id", "recommendation", F.col("priority_score").cast("bigint").alias("priority_score"), "decision_tier",
        F.col("evidence_score").cast("bigint").alias("evidence_score"), _joined("risks"), _joined("missing_information"),
    )
    return made.join(stats, "proposal_id")


def q_scenario_decisions(spark: SparkSession, sf: str) -> DataFrame:
    """Decisions of proposals that each search the tickets of one language only, in one job."""
    proposals, tickets, _ = tables.encoded(spark, sf)
    names = F.array(*[F.lit(c) for c in tables.SCENARIO_LANGUAGES])
    proposals = proposals.withColumn("dataset", F.element_at(names, (F.col("proposal_id") % len(tables.SCENARIO_LANGUAGES) + 1).cast("int")))
    tickets = tickets.withColumn("dataset", F.col("topic"))
    run = pipelines.decision_pipeline(
        proposals, tickets, evidence_threshold=tables.TEXT_GATE, dates=tables.dates(spark, sf), within="dataset"
    )
    made = run.decisions.select(
        "proposal_id", "recommendation", F.col("priority_score").cast("bigint").alias("priority_score"), "decision_tier",
        F.col("evidence_score").cast("bigint").alias("evidence_score"),
    )
    return made.join(run.dedup_stats.select("proposal_id", "total_input_count", "unique_count"), "proposal_id")


def q_truth_hits(spark: SparkSession, sf: str) -> DataFrame:
    """Ranked tickets of each proposal marked by a truth table: relevant are tickets with a label of good quality."""
    _, found = _text_evidence(spark, sf)
    ranked = found.select(F.col("proposal_id").alias("query_id"), "rank", "ticket_id")
    good = tables.table(spark, sf, "labels").where("quality = 1").select(F.col("doc_id").cast("string").alias("ticket_id"))
    truth = ranked.select("query_id", "ticket_id").join(good, "ticket_id")
    queries = evaluate.relevant_counts(tables.proposals(spark, sf).select(F.col("proposal_id").alias("query_id")), truth)
    marked = evaluate.mark_hits(ranked, truth).join(queries, "query_id")
    return marked.select("query_id", F.col("rank").cast("bigint").alias("rank"), "ticket_id", "hit", "total_relevant")


def q_decision_prompt(spark: SparkSession, sf: str) -> DataFrame:
    return _decision_run(spark, sf).prompts


def q_evidence_clusters(spark: SparkSession, sf: str) -> DataFrame:
    run = _decision_run(spark, sf)
    return run.clusters.select("proposal_id", "cluster_id", "theme_label", "size", "intra_cluster_similarity", "representative_ticket_id", _joined("ticket_ids"))


# --- calibration ---------------------------------------------------------------------------------


def _records(spark, sf) -> DataFrame:
    return calibrate.calibration_records(tables.predictions(spark, sf), tables.outcomes(spark, sf))


def q_calib_latest_outcome(spark: SparkSession, sf: str) -> DataFrame:
    return calibrate.latest_outcomes(tables.outcomes(spark, sf))


def q_calib_summary(spark: SparkSession, sf: str) -> DataFrame:
    return calibrate.calibration_summary(_records(spark, sf))


def q_calib_report(spark: SparkSession, sf: str) -> DataFrame:
    return calibrate.calibration_report(calibrate.calibration_summary(_records(spark, sf))).select("status", "summary_text")


def q_calib_bins(spark: SparkSession, sf: str) -> DataFrame:
    return calibrate.reliability_bins(_records(spark, sf)).withColumn("bin_index", F.col("bin_index").cast("bigint"))


def q_calib_tiers(spark: SparkSession, sf: str) -> DataFrame:
    return calibrate.tier_metrics(_records(spark, sf))


def q_prediction_log(spark: SparkSession, sf: str) -> DataFrame:
    """Predictions of all documents saved, those of labelled ones saved again, outcomes and their metadata recorded twice."""
    log = PredictionLog(spark, work_folder(spark, "prediction-log"))
    docs, labels = tables.table(spark, sf, "documents"), tables.table(spark, sf, "labels")
    stamps = tables.table(spark, sf, "events").select(F.col("event_id").alias("doc_id"), "ts")
    found = tables.predictions(spark, sf).join(docs.select(F.col("doc_id").alias("record_id"), "source", "lang"), "record_id")
    found = found.withColumn("metadata", F.create_map(F.lit("source"), "source", F.lit("lang"), "lang"))
    log.save(found.join(stamps.withColumnRenamed("doc_id", "record_id"), "record_id", "left"))
    again = labels.select(F.col("doc_id").alias("record_id"), (F.col("quality") * 60.0 + 20.0).alias("predicted_score"), F.create_map(F.lit("from"), F.lit("label")).alias("metadata"))
    log.save(again)
    kind = F.create_map(F.lit("clean"), (F.col("toxic") == 0).cast("string"))
    first = labels.join(stamps, "doc_id", "left").select(F.col("doc_id").alias("record_id"), F.col("quality").cast("double").alias("actual_outcome"), "ts", kind.alias("metadata"))
    log.record_outcomes(first)
    noted = F.create_map(F.lit("from"), F.lit("outcome"), F.lit("quality"), F.col("quality").cast("string"))
    second = labels.where("toxic = 1").select(F.col("doc_id").alias("record_id"), F.lit(0.25).alias("actual_outcome"), F.lit(None).cast("timestamp").alias("ts"), noted.alias("metadata"))
    log.record_outcomes(second)
    entries = F.transform(F.array_sort(F.map_entries("metadata")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return log.all().select("record_id", "proposal", "predicted_score", "predicted_confidence", "actual_outcome", F.array_join(entries, ";").alias("metadata"))


# --- evaluation ------------------------------------------------------------------------------------


def _ranked_vectors(rows: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """Every vector as a query against all others; relevant are those with the same label."""
    queries = rows.select(F.col("pos").alias("proposal_id"), F.col("vec").alias("query_vec"))
    found = retrieve.retrieve(queries, rows, k + 1, 0.2).where("proposal_id <> pos")
    again = Window.partitionBy("proposal_id").orderBy(F.desc("similarity"), F.desc("pos"))
    ranked = found.withColumn("rank", F.row_number().over(again)).where(F.col("rank") <= k)
    own = rows.select(F.col("pos").alias("query_id"), F.col("label").alias("query_label"))
    ranked = ranked.withColumnRenamed("proposal_id", "query_id").join(own, "query_id")
    hits = ranked.select("query_id", "rank", "similarity", "ticket_id", (F.col("label") == F.col("query_label")).alias("hit"))
    sizes = rows.groupBy(F.col("label").alias("query_label")).agg((F.count("*") - 1).alias("total_relevant"))
    return own.join(sizes, "query_label").select("query_id", "total_relevant"), hits


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


_RATES = ("precision_at_k", "recall_at_k", "reciprocal_rank", "average_precision")


def q_ir_metrics(spark: SparkSession, sf: str) -> DataFrame:
    queries, hits = _ranked_vectors(tables.vectors(spark, sf), 5)
    return _rounded(evaluate.ir_metrics(queries, hits), *_RATES)


def q_ir_macro(spark: SparkSession, sf: str) -> DataFrame:
    queries, hits = _ranked_vectors(tables.vectors(spark, sf), 5)
    return evaluate.ir_macro(evaluate.ir_metrics(queries, hits))


def q_encoder_comparison(spark: SparkSession, sf: str) -> DataFrame:
    """Two encoders of whole texts, hashed TF-IDF and its truncated SVD, on the same queries and truth."""
    tickets, asked = tables.tickets(spark, sf), tables.proposals(spark, sf)
    text = embedding_text(F.col("topic"), F.col("message"))
    encoders = {"tfidf": encode.fit_text_encoder(tickets, text), "svd": dense_encoder.fit_dense_encoder(tickets, text)}
    truth = materialise(tables.passage_truth(spark, sf))
    queries = evaluate.relevant_counts(asked.select(F.col("proposal_id").alias("query_id")), truth)
    return evaluate.compare_encoders(queries, truth, asked, tickets, encoders)


def q_negative_controls(spark: SparkSession, sf: str) -> DataFrame:
    """Conversation turns as queries that should find no benchmark item."""
    proposals, _, fitted = tables.encoded(spark, sf)
    turns = tables.table(spark, sf, "conversations")
    id = F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    controls = turns.select(id.alias("proposal_id"), F.split("text", " ").alias("keywords"))
    controls = pipelines.encode_proposals(controls, fitted)
    items = proposals.select(F.col("proposal_id").alias("pos"), F.col("query_vec").alias("vec"))
    found = retrieve.retrieve(controls, items, 5, 0.2)
    queries = controls.select(F.col("proposal_id").alias("query_id"))
    return evaluate.negative_controls(queries, found.withColumnRenamed("proposal_id", "query_id"), tables.TEXT_GATE)


def _narrow_members(spark, sf) -> DataFrame:
    """Labels of the deduplicated tickets, written once without their texts."""
    members = _semantic_members(spark, sf)
    return materialise(members.select("pos", "ticket_id", "component", "representative_ticket_id", "is_representative", "is_exact"))


def _judged_pairs(spark, sf) -> DataFrame:
    return evaluate.predict_duplicates(tables.annotated_pairs(spark, sf), _narrow_members(spark, sf))


def q_dedup_confusion(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.confusion(_judged_pairs(spark, sf))


def q_dedup_pair_eval(spark: SparkSession, sf: str) -> DataFrame:
    members = _narrow_members(spark, sf)
    stars = dedup.duplicate_members(members).select(F.col("representative_ticket_id").alias("a"), F.col("duplicate_ticket_id").alias("b"))
    truth = tables.annotated_pairs(spark, sf).where("is_duplicate").select(F.col("ticket_a").alias("a"), F.col("ticket_b").alias("b"))
    return evaluate.detected_vs_truth(stars, truth)


def _pairs_with_vectors(spark, sf, pairs_: DataFrame) -> DataFrame:
    """Pairs with texts and vectors of both sides; only tickets that occur in a pair are encoded."""
    fitted = tables.encoder(spark, sf)
    named = pairs_.select(F.explode(F.array("ticket_a", "ticket_b")).alias("ticket_id")).distinct()
    rows = tables.tickets(spark, sf).join(named, "ticket_id", "left_semi")
    return evaluate.annotate_pairs(pairs_, pipelines.encode_tickets(rows, fitted), ["topic", "message", "vec"])


def q_error_causes(spark: SparkSession, sf: str) -> DataFrame:
    wrong = materialise(_judged_pairs(spark, sf).where("is_duplicate <> predicted"))
    wrong = _pairs_with_vectors(spark, sf, wrong)
    wrong = wrong.withColumn("similarity", V.pair_similarity("vec_a", "vec_b"))
    causes = evaluate.error_causes(wrong, 0.85)
    return causes.select("ticket_a", "ticket_b", "error_type", "classified_cause", F.round("similarity", 4).alias("similarity"))


def q_candidate_filters(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.candidate_filters(evaluate.pair_features(_pairs_with_vectors(spark, sf, tables.annotated_pairs(spark, sf))))


def _gate_rows(spark, sf) -> DataFrame:
    queries, hits = _ranked_vectors(tables.vectors(spark, sf), 10)
    return evaluate.gate_sweep_queries(queries, hits, GATES)


def q_gate_sweep(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.gate_sweep(_gate_rows(spark, sf))


def q_dedup_sweep(spark: SparkSession, sf: str) -> DataFrame:
    fitted = tables.encoder(spark, sf)
    keyed = dedup.exact_components(tables.tickets(spark, sf))
    exact = keyed.where("component <> pos").select(F.col("component").alias("a"), F.col("pos").alias("b"), F.lit(1.0).alias("similarity"))
    # tickets with equal keys are linked already: among equal texts only the first needs a vector
    text = F.md5(T.embedding_text(F.col("topic"), F.col("message")))
    first = tables.tickets(spark, sf).groupBy(text).agg(F.min("pos").alias("pos"))
    once = tables.tickets(spark, sf).join(first.select("pos"), "pos", "left_semi")
    alike = _text_edges(fitted)(pipelines.encode_tickets(once, fitted).select("pos", "vec"), min(DEDUP_SWEEP))
    members = keyed.select("pos", "ticket_id", "key", "chars")
    return evaluate.dedup_sweep(tables.annotated_pairs(spark, sf), members, exact.unionByName(alike), DEDUP_SWEEP)


def q_cluster_sweep(spark: SparkSession, sf: str) -> DataFrame:
    """Cluster counts of each proposal's evidence at several cuts, from one merge tree per group."""
    proposals, tickets, _ = tables.encoded(spark, sf)
    found = retrieve.retrieve(proposals, tickets, 10, 0.2)
    cuts = cluster.cluster_groups(found, CLUSTER_SWEEP)
    return pipelines.cluster_counts(cuts)


def q_evaluation_job(spark: SparkSession, sf: str) -> DataFrame:
    """The whole evaluation of the tickets in one job, its summary tables as one row per metric.

    Queries are the benchmark items, relevant the documents that share a passage with them; duplicate
    pairs are labelled by the exact key.
    """
    tickets, fitted = tables.tickets(spark, sf), tables.encoder(spark, sf)
    queries = tables.proposals(spark, sf).select(F.col("proposal_id").alias("query_id"), "keywords")
    run = pipelines.evaluation_job(queries, materialise(tables.passage_truth(spark, sf)), tickets, tables.annotated_pairs(spark, sf), fitted, _text_edges(fitted))
    parts = []
    for name, df, keys in (("retrieval", run.retrieval, []), ("gate", run.gate_sweep, ["threshold"]), ("dedup", run.dedup_sweep, ["threshold"]), ("clusters", run.corpus_cluster_sweep, ["distance_threshold"])):
        at = F.col(keys[0]) if keys else F.lit(None).cast("double")
        values = F.map_from_arrays(F.array(*[F.lit(c) for c in df.columns if c not in keys]), F.array(*[F.col(c).cast("double") for c in df.columns if c not in keys]))
        parts.append(df.select(F.lit(name).alias("part"), at.alias("threshold"), F.explode(values).alias("metric", "value")))
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return every


def _ticket_forest(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Encoded tickets and the merge forest of their whole table."""
    tickets = tables.tickets(spark, sf)
    fitted = tables.encoder(spark, sf)
    rows = materialise(pipelines.encode_tickets(tickets, fitted).where("vec is not null").select("pos", "vec"))
    return rows, merge_forest.merge_forest(rows, _text_edges(fitted), max(CLUSTER_SWEEP))


def q_corpus_cluster_sweep(spark: SparkSession, sf: str) -> DataFrame:
    """Average-link clusters of all tickets at each cut of one merge forest, with cohesion and silhouette."""
    rows, forest = _ticket_forest(spark, sf)
    return merge_forest.sweep_table(rows, forest, CLUSTER_SWEEP)


def q_corpus_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """Average-link clusters of all tickets at the default cut: size, medoid, theme and cohesion."""
    rows, forest = _ticket_forest(spark, sf)
    members = merge_forest.cut_forest(forest, rows, [CLUSTER_DISTANCE]).join(rows, "pos")
    found = merge_forest.cluster_summary(members, ["cluster"])
    texts = tables.tickets(spark, sf).select(F.col("pos").alias("representative_id"), "topic", "message")
    named = found.join(texts, "representative_id")
    theme = cluster.theme_label(F.col("topic"), F.col("message"), F.lit(2))
    return named.select("cluster", "size", "representative_id", theme.alias("theme_label"), T.round_half_even(F.col("cohesion"), 3).alias("intra_cluster_similarity"))


def q_bootstrap_ci(spark: SparkSession, sf: str) -> DataFrame:
    rows = tables.table(spark, sf, "benchmark").select("item_id", (F.length("text") / 100.0).alias("value"))
    return evaluate.bootstrap_ci(rows, "value", ["item_id"])


def q_bootstrap_tree(spark: SparkSession, sf: str) -> DataFrame:
    """Interval of the mean order price over 1,000 resamples of all line items."""
    rows = tables.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("value"))
    return resample.tree_bootstrap_ci(rows, "value", ["l_orderkey", "l_linenumber"])


FLAGSHIP = "q_decision_pipeline"
QUERIES = {name: f for name, f in list(globals().items()) if name.startswith("q_") and callable(f)}
