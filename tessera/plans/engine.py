"""The three entry points over DataFrames: index, query and evaluate. Models are injected callables."""

from __future__ import annotations

import logging
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import audit, chunking, expansion, fusion, grounding, pages, vector
from tessera.operators.answers import Answers
from tessera.operators.lexical import LexicalIndex
from tessera.operators.store import Store
from tessera.sources import files
from tessera.sources.shared import held

log = logging.getLogger(__name__)
Embedder = Callable[[], Callable[[list[str]], list[list[float]]]]

#: What a language model is told: its part, and how a refusal and a caveat must read.
PROMPT = f"""Answer the question from the context below and from nothing else. After each statement give the bracketed locator of
its source exactly as the source's header shows it. If the context answers only a part, say what it leaves out. If it holds
only guidance close to the question, begin with: "{grounding.CAVEAT_PREFIX}" If it holds nothing that bears on it, answer
"{grounding.REFUSAL_PHRASE.capitalize()}." and nothing more.

Context:
"""
#: What is shown in place of a draft.
NO_RESULTS = "No relevant documents found. Please index some documents first."
WITHHELD = "The draft was withheld: its citations could not be matched to the retrieved sources."


@dataclass
class Context:
    """A store opened once: its chunks and its word index (None if it has none)."""

    chunks: DataFrame
    words: LexicalIndex | None


@dataclass
class Engine:
    """A store with the models that work on it. llm answers a prompt, rewriter a question; both may be absent."""

    spark: SparkSession
    path: str
    embedder: Embedder | None = None
    model: str = "stand-in"
    llm: Callable[[str], str] | None = None
    rewriter: Callable[[str], str] | None = None
    reader: files.Reader | None = None
    fetcher: Callable[[str], str] = files.get
    #: Lists of the stored vector index that a question probes; None: all vectors are compared.
    probes: int | None = None
    #: Where answers are kept from run to run; None: each run has a table of its own.
    answers: str | None = None
    opened: Context | None = field(default=None, repr=False)
    said: Answers | None = field(default=None, repr=False)

    @property
    def store(self) -> Store:
        return Store(self.spark, self.path, self.model)

    def table(self) -> Answers:
        """The answers of this run (a call of answer, or an evaluation): each prompt is asked once in it."""
        if self.said is None:
            self.said = Answers(self.spark, self.answers)
        return self.said

    def index(self, path: str, document_type: str, reset: bool = False) -> DataFrame:
        """Load a file, folder or URL by its route, chunk it and merge it; returns the counts (source, added, updated, deleted).

        Chunks are made before a reset clears the store, and without chunks the store is left as it is.
        """
        kind = files.route(path, document_type)
        docs = files.load(self.spark, path, document_type, self.reader, self.fetcher)
        return self._sync(chunking.chunk_handbook(docs) if kind == "handbook" else chunking.chunk_legislation(docs), reset)

    def index_handbook(self, raw_pages: DataFrame, title: str, reset: bool = False) -> DataFrame:
        """Clean, chunk and merge paged sources (source, page_number, text)."""
        docs = pages.extract(raw_pages).withColumns({"title": F.lit(title), "document_type": F.lit("handbook")})
        return self._sync(chunking.chunk_handbook(docs), reset)

    def index_documents(self, documents: DataFrame, reset: bool = False) -> DataFrame:
        """Chunk and merge flat documents (source, title, document_type, text)."""
        return self._sync(chunking.chunk_legislation(documents), reset)

    def _sync(self, chunks: DataFrame, reset: bool) -> DataFrame:
        made = held(chunks)
        if not made.limit(1).count():
            log.warning("no chunks: the store is left as it is")
            return self.spark.createDataFrame([], "source string, added long, updated long, deleted long")
        if reset:
            self.store.clear()
        self.opened = None
        return self.store.sync(made, lambda new: vector.embed(new, model=self.embedder))

    def open(self) -> Context:
        """The store's chunks and word index, opened at the first call and kept until the next merge."""
        if self.opened is None:
            chunks = self.store.read()
            if chunks is None:
                raise ValueError(f"no store at {self.path}")
            self.store.check_model(self.model)
            self.opened = Context(chunks, self.store.lexical())
        return self.opened

    def retrieve(self, questions: DataFrame, mode: str = "hybrid", top_k: int = fusion.TOP_K, intent_weight: float = fusion.INTENT_WEIGHT, document_type: str | None = None, strict: bool = False) -> DataFrame:
        """(query_id, rank, score, chunk columns) of questions (query_id, question, rewrites, intent).

        Bad parameters are errors before anything is read; the intent's weight matters only where there is an intent. An arm
        that fails gives nothing, with a warning, unless strict. Ties go by the order of the store.
        """
        fusion.check(mode, top_k)
        if not 0 <= intent_weight <= fusion.MOST_INTENT and questions.where("trim(intent) <> ''").limit(1).count():
            fusion.check(mode, top_k, intent_weight)
        store = self.open()
        arms = self._arms(document_type)
        if mode in ("hybrid", "bm25") and not store.words:
            log.warning("the store has no word index: %s", "vectors only" if mode == "hybrid" else "no results")
        subs = fusion.sub_queries(questions, intent_weight)
        found = fusion.retrieve(subs, arms if strict else {n: fusion.tolerant(a, n) for n, a in arms.items()}, mode, top_k, key="pos")
        return found.join(store.chunks.drop("embedding"), "pos").drop("pos")

    def retrieve_by(self, questions: DataFrame, plans: Sequence[fusion.Plan], top_k: int = fusion.TOP_K) -> DataFrame:
        """(plan, query_id, rank, score, chunk columns): each arm searches once, and each plan fuses what it found. Failures are errors."""
        for p in plans:
            fusion.check(p.mode, top_k, p.intent_weight)
        subs = held(fusion.sub_queries(questions, fusion.MOST_INTENT))
        needed = {n for p in plans for n in p.arms()}
        store = self.open()
        if "bm25" in needed and not store.words:
            log.warning("the store has no word index")
        lists = fusion.ranked_lists(subs, {n: a for n, a in self._arms().items() if n in needed}, max(fusion.POOL, top_k), "pos")
        if lists is None:
            return store.chunks.drop("embedding", "pos").limit(0).selectExpr("'' as plan", "cast(null as string) as query_id", "1 as rank", "0D as score", "*")
        return fusion.fused(lists, plans, top_k, "pos").join(store.chunks.drop("embedding"), "pos").drop("pos")

    def _arms(self, document_type: str | None = None) -> dict[str, Callable[[DataFrame, int], DataFrame]]:
        store = self.open()
        pool = store.chunks if document_type is None else store.chunks.where(F.col("document_type") == document_type)

        def by_vector(subs: DataFrame, depth: int) -> DataFrame:
            asked = held(vector.embed(subs.select("sub_id", "text"), model=self.embedder).select(F.xxhash64("sub_id").alias("query_id"), "sub_id", "embedding"))
            if self.probes is not None and document_type is None:
                found = self.store.neighbours().search(asked.select("query_id", "embedding"), depth, self.probes, "pos")
            else:
                found = vector.knn(pool.select("pos", "embedding"), asked.select("query_id", "embedding"), depth, key="pos")
            return found.join(asked.select("query_id", "sub_id"), "query_id")

        def by_words(subs: DataFrame, depth: int) -> DataFrame:
            where = None if document_type is None else lambda c: c["document_type"] == document_type
            return store.words.search(subs.select("sub_id", "text"), depth, where, "pos", "sub_id", "text")

        return {"vector": by_vector} | ({"bm25": by_words} if store.words else {})

    def generate(self, asked: DataFrame, found: DataFrame, attempts: int = 1, every: bool = False) -> DataFrame:
        """(query_id, question, context, answer, error, citations, grounded, ungrounded, gate_outcome) of questions with results.

        The language model is asked once for a prompt in a run (or in all that share `answers`), and again after a failure up to
        the attempts; what still fails has a null answer and the last failure in error. Questions without results have no row, or with `every` an empty context.
        """
        if self.llm is None:
            raise ValueError("no language model was given")
        header = F.when(F.col("document_type") == "handbook", fusion.handbook_header(F.col("section_number"), F.col("page_start"), F.col("page_end"))).otherwise(fusion.generic_header(F.col("rank"), F.col("title"), F.col("section_number"), F.col("source")))
        told = fusion.context(found.select("query_id", "rank", header.alias("header"), "text"), asked if every else found.select("query_id").distinct())
        prompt = F.concat(F.lit(PROMPT), "context", F.lit("\n\nQuestion: "), "question")

        asking = asked.select("query_id", "question").join(told, "query_id").withColumn("prompt_", prompt)
        drafts = self.table().ask(asking, "prompt_", self.llm, "generation", attempts).select("query_id", "question", "context", "answer", "error")
        checked = grounding.gate(grounding.verify(drafts.where("error is null").select("query_id", "answer"), found.select("query_id", "section_number", "page_start", "page_end")))
        return drafts.join(checked.drop("answer"), "query_id", "left")

    def answer(self, questions: DataFrame, top_k: int = fusion.TOP_K, override: bool = False, log_to: str | None = None, document_type: str | None = None, intent_weight: float = fusion.INTENT_WEIGHT, rewrite: bool = True) -> DataFrame:
        """(query_id, action, shown, citations, gate_outcome, answer_chars) of questions (query_id, question).

        Expansion, retrieval, generation, verification and display. A draft that is not shown is in no column: a notice
        stands for it, as for a question without results, which is not generated for. A failing language model fails the batch.
        """
        fusion.check("hybrid", top_k)
        self.said = None  # a run of its own: what failed before is asked again
        asked = held(expansion.expand(questions, self.rewriter, enabled=rewrite, answers=self.table()))
        found = held(self.retrieve(asked, top_k=top_k, document_type=document_type, intent_weight=intent_weight))
        drafts = self.generate(asked, found)
        failed = drafts.where("error is not null").select("error").first()
        if failed:
            raise RuntimeError(failed["error"])
        own = asked.select("query_id", F.col("question").alias("asked_")).join(drafts, "query_id", "left").withColumn("has_", F.col("context").isNotNull())
        shown = grounding.display(own, F.col("has_"), override)
        notice = F.when(F.col("action") == "no_results", NO_RESULTS).when(F.col("action") == "blocked_unverified", WITHHELD)
        sizes = own.select("query_id", "gate_outcome", F.coalesce(F.length("answer"), F.lit(0)).alias("answer_chars"))
        out = shown.join(sizes, "query_id").withColumn("shown", F.coalesce("shown", notice)).withColumn("citations", F.coalesce("citations", F.array().cast(shown.schema["citations"].dataType)))
        if log_to is not None:
            got = found.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "section_number", "page_start", "page_end", "score"))).alias("ranked")).select("query_id", F.transform("ranked", lambda r: r.dropFields("rank").withField("id", r["chunk_id"]).dropFields("chunk_id")).alias("retrieved"))
            rows = own.drop("question").join(out.select("query_id", "action"), "query_id").join(asked.select("query_id", "question", "rewrites", F.col("status").alias("rewrite_status"), "intent"), "query_id").join(got, "query_id", "left")
            full = lambda c: F.coalesce(c, F.array().cast(rows.schema[c].dataType))
            rows = rows.withColumns({c: full(c) for c in ("retrieved", "citations", "grounded", "ungrounded")}).withColumn("answer", F.coalesce("answer", F.lit("")))
            rows = rows.withColumns({"top_k": F.lit(top_k), "document_type": F.lit(document_type).cast("string"), "n_grounded": F.size("grounded"), "n_ungrounded": F.size("ungrounded")})
            audit.append(audit.events(rows, raw=audit.keeps_texts()), audit.path(log_to))
        return out

