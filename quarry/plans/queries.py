"""Registered whole-table jobs: one per operator key of SURVEY §2.

Each takes ``(spark, sf_dir)`` and returns a DataFrame; the oracle SQL for
the same key lives in ``quarry.plans.oracle``.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions import ids
from quarry.operators import knn
from quarry.plans import fixtures as fx
from quarry.session import ship_package
from quarry.sources.tables import Tables

QKEY = ["conv_id", "turn"]
REGISTRY: dict = {}


def register(fn):
    @functools.wraps(fn)
    def job(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return fn(spark, sf_dir)

    REGISTRY[fn.__name__] = job
    return fn


# --- search over the given vectors (chunk_index_fx × question_fx) -----------------------

def routed_questions(t: Tables) -> DataFrame:
    q = fx.question_vectors(t)
    ps = ids.query_part_num(F.col("query"))
    q = q.withColumn("ps_num", ps).withColumn(
        "model_num", ids.resolve_id_clash(ids.query_model_num(F.col("query")), F.col("ps_num")))
    return q.withColumn("route", ids.route(F.col("model_num"), F.col("ps_num")))


def _hits(df: DataFrame) -> DataFrame:
    return df.select(*QKEY, "chunk_id", "score", F.col("rank").cast("int").alias("rank"))


@register
def query_model_num(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = fx.question_fx(Tables(spark, sf_dir))
    return q.select(*QKEY, ids.query_model_num(F.col("query")).alias("model_num"))


@register
def query_part_num(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = fx.question_fx(Tables(spark, sf_dir))
    return q.select(*QKEY, ids.query_part_num(F.col("query")).alias("ps_num"))


@register
def resolve_id_clash(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = fx.question_fx(Tables(spark, sf_dir))
    ps = ids.query_part_num(F.col("query"))
    return q.select(*QKEY, ids.resolve_id_clash(ids.query_model_num(F.col("query")), ps).alias("model_num"),
                    ps.alias("ps_num"))


@register
def route_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = fx.question_fx(Tables(spark, sf_dir))
    ps = ids.query_part_num(F.col("query"))
    m = ids.resolve_id_clash(ids.query_model_num(F.col("query")), ps)
    return q.select(*QKEY, m.alias("model_num"), ps.alias("ps_num"), ids.route(m, ps).alias("route"))


@register
def knn_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    return _hits(knn.knn_topk(fx.chunk_index_fx(t), fx.question_vectors(t), 25, qkey=QKEY))


@register
def knn_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    return _hits(knn.knn_filtered(fx.chunk_index_fx(t), routed_questions(t), 25, qkey=QKEY))


@register
def knn_postfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    return _hits(knn.knn_postfilter(fx.chunk_index_fx(t), routed_questions(t), 25, fetch_k=60000, qkey=QKEY))


@register
def knn_postfilter_quarter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The literal filter with a fetch_k of a quarter of the index, so that it cuts some questions' hits."""
    t = Tables(spark, sf_dir)
    index = fx.chunk_index_fx(t)
    return _hits(knn.knn_postfilter(index, routed_questions(t), 25, fetch_k=index.count() // 4, qkey=QKEY))


@register
def knn_with_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    return _hits(knn.knn_with_fallback(fx.chunk_index_fx(t), routed_questions(t), 20, qkey=QKEY))


@register
def search(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    h = knn.search(fx.chunk_index_fx(t), routed_questions(t), 25, 20, qkey=QKEY)
    return h.select(*QKEY, "chunk_id", "score", F.col("rank").cast("int").alias("rank"), "fallback")


# --- HTML → page record (pages table) ------------------------------------------------------

from quarry.functions import html as H  # noqa: E402
from quarry.functions import text as TX  # noqa: E402
from quarry.operators import extract as EX  # noqa: E402
from quarry.operators import links as LK  # noqa: E402
from quarry.functions import urls as U  # noqa: E402
from quarry.session import spread  # noqa: E402

DEFAULT_TAGS, DEFAULT_SEED_TAGS = H.PROFILES["default"]


def _pages(t: Tables) -> DataFrame:
    return spread(t.pages)


def _cleaned(html):
    return H.strip_inputs(H.strip_elements(html, DEFAULT_TAGS))


@register
def strip_elements(spark, sf_dir):
    p = _pages(Tables(spark, sf_dir))
    return p.select("page_id", H.strip_elements(F.col("html"), DEFAULT_TAGS).alias("html"))


@register
def strip_elements_seed(spark, sf_dir):
    t = Tables(spark, sf_dir)
    p = spread(fx.shop_pages_fx(t)).join(fx.frontier_fx(t), "page_id", "left")  # frontier is small: broadcast keeps the spread
    html = H.strip_elements_seed(F.col("html"), F.col("depth"), DEFAULT_TAGS, DEFAULT_SEED_TAGS)
    return p.select("page_id", "depth", html.alias("html"))


@register
def strip_inputs(spark, sf_dir):
    p = spread(fx.shop_pages_fx(Tables(spark, sf_dir)))
    return p.select("page_id", H.strip_inputs(F.col("html")).alias("html"))


@register
def html_to_text(spark, sf_dir):
    p = _pages(Tables(spark, sf_dir))
    return p.select("page_id", H.html_to_text(_cleaned(F.col("html"))).alias("text"))


@register
def collapse_whitespace(spark, sf_dir):
    p = _pages(Tables(spark, sf_dir))
    return p.select("page_id", TX.collapse_whitespace(H.html_to_text(_cleaned(F.col("html")))).alias("text"))


@register
def drop_boilerplate(spark, sf_dir):
    p = spread(fx.shop_pages_fx(Tables(spark, sf_dir)))
    return p.select("page_id", H.page_text(F.col("html"), DEFAULT_TAGS).alias("text"))


@register
def extract_title(spark, sf_dir):
    p = _pages(Tables(spark, sf_dir))
    return p.select("page_id", H.extract_title(F.col("html")).alias("title"))


@register
def drop_untitled(spark, sf_dir):
    p = spread(fx.shop_pages_fx(Tables(spark, sf_dir)))
    return EX.drop_untitled(p.select("page_id", "url", H.extract_title(F.col("html")).alias("title")))


@register
def title_model_num(spark, sf_dir):
    p = _pages(Tables(spark, sf_dir))
    t = p.select("page_id", H.extract_title(F.col("html")).alias("title")).filter(F.col("title").isNotNull())
    return t.select("page_id", "title", H.title_model_num(F.col("title")).alias("model_num"))


@register
def url_part_num(spark, sf_dir):
    p = fx.shop_pages_fx(Tables(spark, sf_dir))
    return p.select("page_id", "url", H.url_part_num(F.col("url")).alias("ps_num"))


def crawled_records(t: Tables) -> DataFrame:
    """Page records of every page, with its depth where the crawl from page 0 reaches it."""
    seeds = t.pages.filter(F.col("page_id") == 0).select("page_id")
    return EX.crawl_records(spread(t.pages), fx.frontier_fx(t), seeds)


@register
def page_records(spark, sf_dir):
    return crawled_records(Tables(spark, sf_dir))


# --- link graph ----------------------------------------------------------------------------

def _links(t: Tables) -> DataFrame:
    c = fx.cleaned_html(t).filter("titled")
    return LK.extract_links(spread(c))


@register
def extract_links(spark, sf_dir):
    return _links(Tables(spark, sf_dir)).select("page_id", "ord", "href")


@register
def resolve_links(spark, sf_dir):
    return LK.resolve_links(_links(Tables(spark, sf_dir))).select("page_id", "ord", "href", "abs_url")


def _shop_links(t: Tables) -> DataFrame:
    p = spread(fx.shop_pages_fx(t)).select("page_id", "url", _cleaned(F.col("html")).alias("html"), H.has_title(F.col("html")).alias("titled"))
    return LK.extract_links(p.filter("titled"))


def _site_links(t: Tables, links: DataFrame | None = None) -> DataFrame:
    r = LK.resolve_links(_links(t) if links is None else links)
    return LK.filter_links(r, prefix=F.concat(U.origin(F.col("url")), F.lit("/")))


@register
def filter_links(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return _site_links(t, _shop_links(t)).select("page_id", "ord", "abs_url")


@register
def dedupe_urls(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return LK.dedupe_urls(_site_links(t).select(F.col("abs_url").alias("url")), t.pages.select("url"))


@register
def crawl_frontier(spark, sf_dir):
    return fx.frontier_fx(Tables(spark, sf_dir))


# --- chunking, embedding, index (documents and crawled pages) -----------------------------

from quarry.operators import chunk as CH  # noqa: E402
from quarry.operators import embed as EM  # noqa: E402
from quarry.operators import keyed as KX  # noqa: E402
from quarry.operators import index as IX  # noqa: E402
from quarry.session import work_path  # noqa: E402
from quarry.sources import files as FS  # noqa: E402


def _chunks_of_documents(t: Tables, size, overlap, sep) -> DataFrame:
    d = spread(t.documents.select("doc_id", "text") if sep == CH.WORD_SEP else fx.paragraphs_fx(t))
    return CH.chunk_documents(d, "text", size, overlap, sep).select("doc_id", "chunk_idx", "text")


@register
def chunk_words(spark, sf_dir):
    return _chunks_of_documents(Tables(spark, sf_dir), 1000, 200, CH.WORD_SEP)


@register
def chunk_paragraphs(spark, sf_dir):
    return _chunks_of_documents(Tables(spark, sf_dir), 1000, 200, CH.PARAGRAPH_SEP)


@register
def chunk_paragraphs_no_overlap(spark, sf_dir):
    return _chunks_of_documents(Tables(spark, sf_dir), 1000, 0, CH.PARAGRAPH_SEP)


def _sparse(df: DataFrame, keys, vec: str = "embedding") -> DataFrame:
    # outer generator: an inner one would get an inferred size filter that runs the embedder twice
    x = df.select(*keys, F.posexplode_outer(vec).alias("bucket", "value"))
    return x.filter(F.col("value") != 0).select(*keys, F.col("bucket").cast("int").alias("bucket"),
                                                F.col("value").cast("double").alias("value"))


@register
def embed_documents(spark, sf_dir):
    d = spread(Tables(spark, sf_dir).documents.select("doc_id", "text"))
    return _sparse(EM.embed_documents(d, "text"), ["doc_id"])


@register
def embed_queries(spark, sf_dir):
    q = fx.question_fx(Tables(spark, sf_dir))
    return _sparse(EM.embed_queries(q, "query", out="qvec"), list(QKEY), "qvec")


def _fingerprint(vec: str = "embedding"):
    v = F.col(vec)
    return [
        F.size(F.filter(v, lambda x: x != 0)).alias("emb_nnz"),
        F.round(F.aggregate(F.transform(v, lambda x, i: x.cast("double") * (i + 1)), F.lit(0.0),
                            lambda a, b: a + b), 6).alias("emb_sig"),
    ]


def _index_view(df: DataFrame) -> DataFrame:
    return df.select("chunk_id", "doc_id", "url", "chunk_idx", "text", "depth", "title", "model_num", "ps_num",
                     *_fingerprint())


def page_documents(t: Tables) -> DataFrame:
    return IX.compose_document(crawled_records(t))


@register
def compose_document(spark, sf_dir):
    return page_documents(Tables(spark, sf_dir))


@register
def build_index(spark, sf_dir):
    t = Tables(spark, sf_dir)
    idx = IX.build_index(page_documents(t), work_path(spark, "index"))
    return _index_view(idx)


@register
def load_index(spark, sf_dir):
    t = Tables(spark, sf_dir)
    path = work_path(spark, "index")
    IX.build_index(page_documents(t), path)
    idx = IX.load_index(spark, path)
    return idx.select("chunk_id", "url", "chunk_idx", F.size("embedding").alias("dim"))


@register
def append_index(spark, sf_dir):
    """Two appends: a capped first run (cap 300 → one batch edge past it), then a resume."""
    t = Tables(spark, sf_dir)
    path = work_path(spark, "index")
    # cut once: both runs count and read the written chunks
    staged = work_path(spark, "chunks")
    IX.chunk_rows(page_documents(t)).write.parquet(staged)
    chunks = spark.read.parquet(staged)
    nxt = IX.append_index(chunks, path, resume=0, cap=300)
    IX.append_index(chunks, path, resume=nxt)
    return _index_view(IX.load_index(spark, path))


@register
def upsert_index(spark, sf_dir):
    """All pages' index of 500/100 chunks, kept by key; those three links or more from the start come again as 1000/200 chunks."""
    t = Tables(spark, sf_dir)
    docs, path = page_documents(t), work_path(spark, "index-keyed")
    KX.write_keyed(IX.index_rows(docs, size=500, overlap=100), path)
    KX.merge(IX.index_rows(docs.filter("depth >= 3")), path)
    return _index_view(KX.load_keyed(spark, path))


# --- file sources and sinks ----------------------------------------------------------------

@register
def append_page_csv(spark, sf_dir):
    """Records appended in two runs (seed page, then the rest) and read back."""
    rec = crawled_records(Tables(spark, sf_dir))
    path = work_path(spark, "pages-csv")
    FS.append_page_csv(rec.filter(F.col("depth") == 0), path)
    FS.append_page_csv(rec.filter(F.coalesce(F.col("depth") != 0, F.lit(True))), path)
    return FS.scan_page_csv(spark, path)


@register
def append_pages(spark, sf_dir):
    """Records appended to the Parquet page store in two runs (seed page, then the rest) and read back."""
    rec = crawled_records(Tables(spark, sf_dir))
    path = work_path(spark, "pages")
    FS.append_pages(rec.filter(F.col("depth") == 0), path)
    FS.append_pages(rec.filter(F.coalesce(F.col("depth") != 0, F.lit(True))), path)
    return FS.scan_pages(spark, path)


@register
def scan_pages(spark, sf_dir):
    """The page store's records up to three links from the start: deeper folders are not read."""
    path = work_path(spark, "pages")
    FS.append_pages(crawled_records(Tables(spark, sf_dir)), path)
    return FS.scan_pages(spark, path, max_depth=3)


@register
def scan_page_csv(spark, sf_dir):
    rec = crawled_records(Tables(spark, sf_dir))
    path = work_path(spark, "pages-csv")
    FS.append_page_csv(rec, path)
    return FS.scan_page_csv(spark, path)


@register
def scan_text_url_csv(spark, sf_dir):
    rec = crawled_records(Tables(spark, sf_dir))
    path = work_path(spark, "text-url-csv")
    FS.write_text_url_csv(rec, path)
    df = FS.scan_text_url_csv(spark, path)
    return df.select("text", "url", F.col("source").endswith(".csv").alias("from_file"))


@register
def map_crawl_items(spark, sf_dir):
    """Page text as crawled items (empty text stored as null), mapped back to documents."""
    rec = crawled_records(Tables(spark, sf_dir))
    path = work_path(spark, "crawl-items")
    FS.write_crawl_items(rec.select(F.nullif(F.col("text"), F.lit("")).alias("text"), "url"), path)
    return FS.map_crawl_items(spark, path)


# --- retrieval over the page index and context packing -------------------------------------

from quarry.operators import context as CX  # noqa: E402


def page_index(spark: SparkSession, t: Tables) -> DataFrame:
    """Index of the crawled pages (written once, read back)."""
    return IX.build_index(page_documents(t), work_path(spark, "index"))


def page_questions(t: Tables) -> DataFrame:
    """User turns as questions with hash-embedded vectors and routed ids."""
    q = EM.embed_queries(fx.question_fx(t), "query", out="qvec")
    q = q.withColumn("ps_num", ids.query_part_num(F.col("query"))).withColumn(
        "model_num", ids.resolve_id_clash(ids.query_model_num(F.col("query")), F.col("ps_num")))
    return q.withColumn("route", ids.route(F.col("model_num"), F.col("ps_num")))


def append_hits(spark: SparkSession, hits: DataFrame, path: str) -> DataFrame:
    """Append one search's hit lists (with the documents, as the reference keeps them) and read back."""
    cols = [*QKEY, F.col("rank").cast("int").alias("rank"), "chunk_id", "score", "fallback"]
    cols += [c for c in ("text", "url") if c in hits.columns]
    hits.select(*cols).write.mode("append").parquet(path)
    return spark.read.parquet(path)


class Session:
    """Index, questions and search history of one run (each written once)."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.t = Tables(spark, sf_dir)
        self.index = page_index(spark, self.t)
        # embedded once: both searches and the packers read the written batch
        qpath = work_path(spark, "questions")
        page_questions(self.t).write.parquet(qpath)
        self.questions = spark.read.parquet(qpath)
        hits = knn.search(self.index, self.questions, 25, 20, qkey=QKEY)
        # documents attached in the same job (hits ≤ questions × 25 are broadcast, the index streams once);
        # every packer reads this history table
        bound = self.questions.count() * 25
        self.hits = append_hits(spark, CX.hit_text(hits, self.index, bound), work_path(spark, "search-history"))
        self.hits_text = self.hits
        answered = self.hits.select(*QKEY).distinct()
        apath = work_path(spark, "answer-history")
        CX.answer_history(self.t.conversations).join(answered, QKEY, "left_semi").write.parquet(apath)
        self.answers = spark.read.parquet(apath)

    def docs(self, intro=CX.INTRO_TEXT):
        return CX.pack_documents(self.questions, CX.hit_articles(self.hits_text, self.index), intro)

    def prior(self):
        return CX.pack_prior_hits(self.questions, self.hits_text, self.index)

    def prior_answers(self):
        return CX.pack_prior_answers(self.questions, self.answers)

    def prompts(self, intro=CX.INTRO_TEXT):
        return CX.build_prompt(self.questions, self.docs(intro), self.prior(), self.prior_answers(), intro)


@register
def append_search_history(spark, sf_dir):
    s = Session(spark, sf_dir)
    return s.hits.select(*QKEY, "rank", "chunk_id", "score", "fallback")


@register
def count_tokens(spark, sf_dir):
    c = Tables(spark, sf_dir).conversations
    return c.select(*QKEY, CX.count_tokens(F.col("text")).alias("tokens"))


@register
def pack_documents(spark, sf_dir):
    return Session(spark, sf_dir).docs().select(*QKEY, "rank", "chunk_id", "tokens")


@register
def pack_prior_hits(spark, sf_dir):
    return Session(spark, sf_dir).prior().select(*QKEY, "src_turn", "rank", "chunk_id", "tokens")


@register
def pack_prior_answers(spark, sf_dir):
    return Session(spark, sf_dir).prior_answers().select(*QKEY, "src_turn", "tokens")


@register
def build_prompt(spark, sf_dir):
    return Session(spark, sf_dir).prompts()


@register
def no_hit_answer(spark, sf_dir):
    s = Session(spark, sf_dir)
    return CX.no_hit_answer(s.questions, s.hits)


@register
def style_variant(spark, sf_dir):
    s = Session(spark, sf_dir)
    return CX.style_variant(s.prompts({channel: intro for channel, (intro, _) in CX.INTROS.items()}))


@register
def append_answer_history(spark, sf_dir):
    return CX.answer_history(Tables(spark, sf_dir).conversations)


# --- stage timings ---------------------------------------------------------------------------

from quarry.operators import metrics as MT  # noqa: E402


@register
def stage_totals(spark, sf_dir):
    return MT.stage_totals(fx.timing_fx(Tables(spark, sf_dir)))


@register
def stage_averages(spark, sf_dir):
    return MT.stage_averages(fx.timing_fx(Tables(spark, sf_dir)))


@register
def last_run_stats(spark, sf_dir):
    return MT.last_run_stats(fx.timing_fx(Tables(spark, sf_dir)))


# --- streaming forms -------------------------------------------------------------------------

from quarry.streaming import context as SC  # noqa: E402
from quarry.streaming import ingest as SI  # noqa: E402
from quarry.streaming import timed as TM  # noqa: E402


@register
def stream_ingest(spark, sf_dir):
    """Page records arrive as files, all of them twice; the stream merges their chunks into the keyed index (6 micro-batches)."""
    rec = crawled_records(Tables(spark, sf_dir))
    source, index_path = work_path(spark, "ingest-source"), work_path(spark, "index")
    rec = rec.select(*[f.name for f in SI.PAGE_RECORD.fields])
    rec.repartition(3).write.parquet(source)
    spark.read.schema(SI.PAGE_RECORD).parquet(source).repartition(3).write.mode("append").parquet(source)
    q = SI.stream_ingest(spark, source, index_path, work_path(spark, "ingest-checkpoint"), files_per_trigger=1)
    q.awaitTermination()
    return _index_view(KX.load_keyed(spark, index_path))


def context_events(s: "Session") -> DataFrame:
    """One event per question turn: its top hits (with earlier-webpage tokens) and its answer tokens."""
    h = s.hits_text.filter(F.col("rank") <= CX.PRIOR_HITS_PER_TURN)
    h = h.withColumn("tokens", CX.count_tokens(CX.prior_article(F.col("text"), F.col("url"))))
    hits = h.groupBy(*QKEY).agg(F.collect_list(F.struct(F.col("rank").cast("int").alias("rank"), "chunk_id",
                                                        F.col("tokens").cast("int").alias("tokens"))).alias("hits"))
    ans = s.answers.select(*QKEY, CX.count_tokens(F.col("qa")).alias("answer_tokens"))
    return s.questions.select(*QKEY).join(hits, QKEY, "left").join(ans, QKEY, "left")


@register
def stream_context(spark, sf_dir):
    s = Session(spark, sf_dir)
    source, sink = work_path(spark, "context-source"), work_path(spark, "context-out")
    context_events(s).select(*[f.name for f in SC.EVENT.fields]).write.parquet(source)
    events = spark.readStream.schema(SC.EVENT).parquet(source)
    q = (SC.stream_context(events).writeStream.format("parquet").option("path", sink)
         .option("checkpointLocation", work_path(spark, "context-checkpoint")).trigger(availableNow=True)
         .outputMode("append").start())
    q.awaitTermination()
    return spark.read.schema(SC.OUT).parquet(sink)


@register
def stream_context_timed(spark, sf_dir):
    """The same rows when turns arrive up to two turns out of order, in four runs that resume from the checkpoint."""
    s = Session(spark, sf_dir)
    staged, source, sink, checkpoint = (work_path(spark, f"timed-{x}") for x in ("staged", "source", "out", "checkpoint"))
    # stand-in times and arrival: a turn a minute from 2024 on, each up to two minutes after its place
    arrival = F.floor((F.col("turn") + F.pmod(F.xxhash64("conv_id", "turn"), F.lit(3))) / 3)
    (context_events(s).withColumn("ts", F.timestamp_seconds(F.unix_timestamp(F.lit("2024-01-01 00:00:00")) + F.col("turn") * 60)).withColumn("run", F.least(arrival, F.lit(2)))
     .select(*TM.TIMED.names, "run").write.partitionBy("run").parquet(staged))
    events = spark.read.schema(T.StructType([*TM.TIMED.fields, T.StructField("run", T.IntegerType())])).parquet(staged)
    # a last row without a conversation carries the time past the end of all
    close = events.agg(F.lit(None).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("turn"), F.lit(None).cast(TM.TIMED["hits"].dataType).alias("hits"),
                       F.lit(None).cast("int").alias("answer_tokens"), (F.max("ts") + F.expr("interval 2 days")).alias("ts"))
    for part in [*(events.filter(F.col("run") == r).drop("run") for r in range(3)), close]:
        part.write.mode("append").parquet(source)
        stream = TM.stream_context_timed(spark.readStream.schema(TM.TIMED).parquet(source), delay="2 minutes")
        with TM.state_store(spark):
            (stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).outputMode("append").start().awaitTermination())
    return spark.read.schema(TM.OUT).parquet(sink)
