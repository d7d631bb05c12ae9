"""The engine: namespaces of documents that are cut, embedded, stored and searched.

Every call reads a version of the store and commits the next. Rows of many documents
go through one plan; single documents are a table of one row.
"""

from __future__ import annotations

import time
from collections import Counter, OrderedDict
from collections.abc import Callable
from copy import copy

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brackwater.functions.text import MODELS, content_hash, mock_embedding
from brackwater.operators import chunking
from brackwater.operators.filters import request_filter
from brackwater.operators.search import Index, index_of, merge_domains, search, with_vectors
from brackwater.operators.sizes import broadcast_if_small, build_side
from brackwater.schema import TABLES
from brackwater.sources.extract import extract
from brackwater.sources.store import Store

#: Tables whose rows go with their document.
OF_DOCUMENTS = ("documents", "chunks", "embeddings", "document_hashes")
#: How many embedded queries are remembered, and how many rows a page of a listing may have at most.
REMEMBERED = 256
MOST_ROWS = 500
INPUT = "title string, source string, subdomain string, labels array<string>, metadata map<string,string>, text string, chunks array<string>"


def ended(jobs: DataFrame, now_ms: int, retention_ms: int) -> Column:
    """Whether a job ended longer ago than the retention."""
    return F.coalesce(jobs["status"].isin("Done", "Failed") & (jobs["updated_at"] < now_ms - retention_ms), F.lit(False))


def _densely(rows: DataFrame) -> DataFrame:
    """m, of monotonically_increasing_id(), without its gaps: one count a partition goes through the driver."""
    counts = rows.groupBy(F.shiftright("m", 33).alias("p")).count().orderBy("p").collect()
    offset, pairs = 0, []
    for p, count in counts:
        pairs += [F.lit(p), F.lit(offset)]
        offset += count
    if not pairs:
        return rows
    return rows.withColumn("m", F.create_map(*pairs)[F.shiftright("m", 33)].cast("long") + F.col("m").bitwiseAND((1 << 33) - 1))


class NotFound(KeyError):
    """No row with that id."""


class Engine:
    """A store with embedders, a chunker, a kind of index and perhaps a reranker.

    ``index_kind`` is a name or a function like those of operators.search.INDEXES, the
    chunker any function from a text to its chunks. ``counts`` holds what this engine
    has done: searches and the milliseconds they took to plan, documents ingested, and
    duplicates.
    """

    def __init__(self, spark: SparkSession, root: str, index_kind: str | Index = "flat", embedders: dict[str, Callable] | None = None, reranker: Callable[[Column, Column], Column] | None = None,
                 clock: Callable[[], int] | None = None, chunker: Callable[[str], list[str]] = chunking.chunk_text, key: bytes | None = None):
        self.spark, self.store, self.reranker, self.chunker = spark, Store(spark, root, key), reranker, chunker
        self.index = index_of(index_kind)
        self.counts = Counter()
        self._vectors: OrderedDict[tuple[str, str], list[float]] = OrderedDict()
        self.embedders = embedders or {"mock": mock_embedding(MODELS["mock"][0])}
        self.clock = clock or (lambda: int(time.time() * 1000))

    # rows

    def table(self, name: str, domain_ids: list[int] | None = None) -> DataFrame:
        """A current table, without what belongs to deleted documents."""
        rows = self.store.table(name, domain_ids)
        if name in OF_DOCUMENTS and self.store.manifest().get("deletions"):
            gone = broadcast_if_small(self.store.table("deletions", domain_ids).select(F.col("document_id").alias("gone")))
            rows = rows.join(gone, rows["id" if name == "documents" else "document_id"] == gone["gone"], "left_anti")
        return rows

    def get(self, name: str, row_id: int):
        """The row of an id."""
        found = self.table(name).where(F.col("id") == row_id).limit(1).collect()
        if not found:
            raise NotFound(f"{name} {row_id}")
        return found[0]

    def page(self, name: str, domain_id: int | None = None, offset: int = 0, limit: int = 100, most: int | None = MOST_ROWS) -> DataFrame:
        """Rows in the order of their ids, as many as the limit and the most that a page may have."""
        rows = self.table(name, None if domain_id is None else [domain_id])
        return rows.orderBy("id").offset(max(0, offset)).limit(max(0, limit if most is None else min(limit, most)))

    def count(self, name: str, domain_id: int | None = None) -> int:
        """How many rows a table has."""
        return self.table(name, None if domain_id is None else [domain_id]).count()

    def purge_jobs(self, now_ms: int, retention_ms: int) -> int:
        """Forget the jobs that ended longer ago than the retention; how many."""
        jobs = self.table("jobs")
        old = ended(jobs, now_ms, retention_ms)
        gone = jobs.where(old).count()
        if gone:
            self.store.commit({"jobs": jobs.where(~old)})
        return gone

    def fork(self, root: str) -> Engine:
        """An engine of the same settings over a store of its own that begins with this one's tables, none of which is copied."""
        other = copy(self)
        other.store, other.counts, other._vectors = Store(self.spark, root, self.store.key), Counter(), OrderedDict()
        other.store.publish(self.store.manifest(), 0)
        return other

    def persist_indexes(self) -> int:
        """How many indexes were written: none, as an index is what the tables hold."""
        return 0

    def _next_id(self, name: str) -> int:
        used = [self.store.table(name).agg(F.max("id")).first()[0] or 0]
        if name == "documents":  # the number of a deleted document isn't given again
            used.append(self.store.table("deletions").agg(F.max("document_id")).first()[0] or 0)
        return max(used) + 1

    def _row(self, table: str, /, **values) -> DataFrame:
        return self.spark.createDataFrame([tuple(values.get(f.name) for f in TABLES[table].fields)], TABLES[table])

    # names

    def create_domain(self, name: str, model: str = "mock") -> int:
        """A new namespace, bound to a model; the id. Names may repeat."""
        if model not in self.embedders:
            raise ValueError(f"no embedder for {model!r}")
        new = self._next_id("domains")
        self.store.commit({}, appends={"domains": self._row("domains", id=new, name=name, model=model, dim=MODELS[model][0], created_at=self.clock())})
        return new

    def _named(self, table: str, domain_id: int, names: list[str]) -> dict[str, int]:
        """Ids of names, making those that aren't there; a name of several rows has the last."""
        self.get("domains", domain_id)
        have = self.tag_ids(domain_id) if table == "tags" else self.subdomain_ids(domain_id)
        fresh = [n for n in dict.fromkeys(names) if n not in have]
        if fresh:
            first, now = self._next_id(table), self.clock()
            values = [{"id": first + k, "domain_id": domain_id, "name": n, "display_name": n, "created_at": now} for k, n in enumerate(fresh)]
            rows = self.spark.createDataFrame([tuple(v.get(f.name) for f in TABLES[table].fields) for v in values], TABLES[table])
            self.store.commit({}, appends={table: rows})
            have |= {v["name"]: v["id"] for v in values}
        return {n: have[n] for n in names}

    def get_or_create_tags(self, domain_id: int, names: list[str]) -> dict[str, int]:
        """Ids of labels by name."""
        return self._named("tags", domain_id, names)

    def get_or_create_subdomains(self, domain_id: int, names: list[str]) -> dict[str, int]:
        """Ids of topics by name."""
        return self._named("subdomains", domain_id, names)

    def create_tag(self, domain_id: int, name: str, display_name: str | None = None, description: str | None = None, parent: int | None = None) -> int:
        """A new label, even if one of the name exists; the name then means the new one. The parent is for information."""
        self.get("domains", domain_id)
        new = self._next_id("tags")
        self.store.commit({}, appends={"tags": self._row("tags", id=new, domain_id=domain_id, name=name, display_name=display_name or name, description=description, parent=parent, created_at=self.clock())})
        return new

    def tag_ids(self, domain_id: int) -> dict[str, int]:
        """The vocabulary of a domain: names and ids, small by nature."""
        return {r.name: r.id for r in self.table("tags", [domain_id]).select("name", "id").orderBy("id").collect()}

    def subdomain_ids(self, domain_id: int) -> dict[str, int]:
        """The topics of a domain."""
        return {r.name: r.id for r in self.table("subdomains", [domain_id]).select("name", "id").orderBy("id").collect()}

    # writing

    def ingest(self, domain_id: int, docs: DataFrame, dedup: bool = True) -> DataFrame:
        """Store documents of INPUT's columns (those that are absent count as null), with a key ``n`` that gives their order.

        Gives (n, document_id, chunk_count, duplicate). Of equal contents in a domain
        only the first is stored, and none that is stored already; a duplicate has the
        id of the document that stands. Chunks are taken verbatim where they are given,
        else the text is cut. Labels and topics are made as needed.
        """
        domain = self.get("domains", domain_id)
        kinds = dict(part.strip().split(" ", 1) for part in INPUT.replace("<string,string>", "<string;string>").split(","))
        for name, kind in kinds.items():
            if name not in docs.columns:
                docs = docs.withColumn(name, F.lit(None).cast(kind.replace(";", ",")))
        work = f"{self.store.root}/_staging/{self.clock()}-{id(docs)}"
        body = F.when(F.col("chunks").isNotNull(), F.concat_ws("\n", "chunks")).otherwise(F.col("text"))
        hashed = docs.select("n", *kinds, content_hash(F.coalesce(body, F.lit(""))).alias("sha256"), F.monotonically_increasing_id().alias("r"))
        hashed.write.parquet(work)
        docs = self.spark.read.schema(hashed.schema).parquet(work)
        # what orders and compares documents goes without their texts
        docs.select("r", "n", "sha256").orderBy("n", "r").withColumn("m", F.monotonically_increasing_id()).write.parquet(work + "-order")
        order = _densely(self.spark.read.parquet(work + "-order"))
        labels = [r[0] for r in docs.select(F.explode("labels")).distinct().where("col is not null").collect()]
        topics = [r[0] for r in docs.select("subdomain").distinct().where("subdomain is not null").collect()]
        tags = self.get_or_create_tags(domain_id, sorted(labels))
        subs = self.get_or_create_subdomains(domain_id, sorted(topics))
        base, first = self.store.version(), self._next_id("documents")
        live = self.table("documents", [domain_id]).select(F.col("id").alias("document_id"))
        known = self.table("document_hashes", [domain_id]).join(live, "document_id", "left_semi").groupBy("sha256").agg(F.min("document_id").alias("old"))
        by_hash = Window.partitionBy("sha256").orderBy("m")
        placed = order.join(known, "sha256", "left").withColumn("copy", F.row_number().over(by_hash)) if dedup else order.withColumn("old", F.lit(None).cast("long")).withColumn("copy", F.lit(1))
        placed = placed.withColumn("id", F.when(F.col("old").isNull() & (F.col("copy") == 1), F.col("m") + first))
        placed.write.parquet(work + "-placed")
        placed = self.spark.read.parquet(work + "-placed")
        fresh = docs.drop("n").join(build_side(placed.where("id is not null").select("r", "id")), "r")
        tag_map = F.create_map(*(F.lit(x) for kv in tags.items() for x in kv)) if tags else F.create_map().cast("map<string,bigint>")
        sub_map = F.create_map(*(F.lit(x) for kv in subs.items() for x in kv)) if subs else F.create_map().cast("map<string,bigint>")
        rows = fresh.select(
            "id", F.lit(domain_id).cast("long").alias("domain_id"), sub_map[F.col("subdomain")].alias("subdomain_id"), F.coalesce("title", F.lit("")).alias("title"), "source",
            F.coalesce("metadata", F.create_map().cast("map<string,string>")).alias("metadata"),
            F.array_distinct(F.transform(F.coalesce("labels", F.array().cast("array<string>")), lambda x: tag_map[x].cast("long"))).alias("tags"),
            F.lit(self.clock()).cast("long").alias("created_at"), "text", "chunks", "sha256",
        )
        carried = ["id", "domain_id", "subdomain_id", "tags", "metadata"]
        cut = chunking.chunks(rows.where("chunks is null").select(*carried, "text"), splitter=self.chunker)
        split = rows.where("chunks is not null").select(*carried, F.posexplode("chunks").alias("ordinal", "text"), F.size("chunks").alias("many"))
        here = chunking.chunk_id(F.col("id"), F.col("ordinal"))
        given = split.select(here.alias("chunk_id"), F.col("id").alias("document_id"), "ordinal", "text", F.when(F.col("ordinal") > 0, here - 1).alias("prev"), F.when(F.col("ordinal") + 1 < F.col("many"), here + 1).alias("next"), *carried[1:])
        written = self.store.put("chunks", cut.unionByName(given).withColumnRenamed("chunk_id", "id"))
        made = self.store.at("chunks", written)
        self.store.commit({}, domain_id, {
            "documents": rows, "chunks": written, "embeddings": self._embedded(made, domain.model), "document_hashes": placed.where("id is not null").select(F.lit(domain_id).alias("domain_id"), "sha256", F.col("id").alias("document_id")),
        }, base)
        self.store.files.delete(work)
        stood, copies = placed.agg(F.count("id"), F.count_if(F.col("id").isNull())).first()
        self.counts.update(ingested=stood, duplicates=copies)
        counts = made.groupBy("document_id").agg(F.count("*").cast("int").alias("chunk_count"))
        first_of = placed.where("id is not null").select("sha256", F.col("id").alias("own"))
        answer = placed.join(first_of.dropDuplicates(["sha256"]), "sha256", "left")
        answer = answer.select("n", F.coalesce("id", "old", "own").alias("document_id"), F.col("id").isNull().alias("duplicate"))
        return answer.join(broadcast_if_small(counts), "document_id", "left").select("n", "document_id", F.when(F.col("duplicate"), 0).otherwise(F.coalesce("chunk_count", F.lit(0))).alias("chunk_count"), "duplicate")

    def _embedded(self, chunks: DataFrame, model: str) -> DataFrame:
        return chunks.select(F.col("id").alias("chunk_id"), "document_id", "domain_id", self.embedders[model](F.col("text")).alias("embedding"))

    def ingest_text(self, domain_id: int, title: str, text: str | None = None, chunks: list[str] | None = None, source: str | None = None, metadata: dict | None = None, labels: list[str] | None = None, subdomain: str | None = None):
        """One document; (n, document_id, chunk_count, duplicate)."""
        row = [(0, title, source, subdomain, labels, metadata, text, chunks)]
        return self.ingest(domain_id, self.spark.createDataFrame(row, "n int, " + INPUT)).first()

    def ingest_files(self, domain_id: int, files: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Documents of files (path, content); what ingest() gives and the files that can't be read, with their error."""
        read = extract(files.select("path", "content")).withColumn("n", F.col("path"))
        good = read.where("error is null").select("n", F.element_at(F.split("path", "/"), -1).alias("title"), F.col("path").alias("source"), "text")
        return self.ingest(domain_id, good), read.where("error is not null").select("path", "error")

    # edits: deletions are a list beside the tables, other edits rewrite what the domain has of the tables they touch

    def _rewrite(self, domain_id: int, **tables: DataFrame) -> None:
        for name, df in list(tables.items()):
            if name not in ("documents", "chunks", "embeddings"):  # these are whole tables
                tables[name] = self.table(name).where(F.col("domain_id") != domain_id).unionByName(df)
        self.store.commit(tables, domain_id)

    def delete_document(self, document_id: int) -> None:
        """With its chunks, embeddings and hash: its number is noted, and left out by what reads."""
        row = self.get("documents", document_id)
        self.store.commit({}, appends={"deletions": self._row("deletions", domain_id=row.domain_id, document_id=document_id)})

    def delete_subdomain(self, subdomain_id: int) -> None:
        """With its documents."""
        row = self.get("subdomains", subdomain_id)
        gone = self.table("documents", [row.domain_id]).where(F.col("subdomain_id") == subdomain_id).select("domain_id", F.col("id").alias("document_id"))
        self.store.commit({"subdomains": self.table("subdomains").where(F.col("id") != subdomain_id)}, appends={"deletions": gone})

    def compact(self, domain_id: int) -> None:
        """Write the domain's tables anew, each as one part, without what was deleted."""
        last = self._next_id("documents") - 1
        kept = self.store.table("deletions").where((F.col("domain_id") != domain_id) | (F.col("document_id") == last))  # the last number stays noted
        self._rewrite(domain_id, **{n: self.table(n, [domain_id]) for n in OF_DOCUMENTS})
        if self.store.manifest().get("deletions"):
            self.store.commit({"deletions": kept})

    def delete_domain(self, domain_id: int) -> None:
        """With everything in it."""
        self.get("domains", domain_id)
        others = {n: self.table(n).where(F.col("domain_id") != domain_id) for n in ("subdomains", "tags", "document_hashes", "deletions", "jobs") if self.store.manifest().get(n)}
        others["domains"] = self.table("domains").where(F.col("id") != domain_id)
        self.store.drop_domain(domain_id, others)

    def delete_tag(self, tag_id: int) -> None:
        """Documents and chunks stay and lose the label; labels below it keep naming it as their parent."""
        row = self.get("tags", tag_id)
        own = {n: self.table(n, [row.domain_id]).withColumn("tags", F.array_remove("tags", F.lit(tag_id).cast("long"))) for n in ("documents", "chunks")}
        self._rewrite(row.domain_id, tags=self.table("tags", [row.domain_id]).where(F.col("id") != tag_id), **own)

    def rename_domain(self, domain_id: int, name: str) -> None:
        """Names aren't checked for being unique."""
        self.get("domains", domain_id)
        self.store.commit({"domains": self.table("domains").withColumn("name", F.when(F.col("id") == domain_id, F.lit(name)).otherwise(F.col("name")))})

    def update_tag(self, tag_id: int, display_name: str | None = None, description: str | None = None) -> None:
        """What is given changes; the name doesn't."""
        row = self.get("tags", tag_id)
        tags = self.table("tags", [row.domain_id])
        for column, value in (("display_name", display_name), ("description", description)):
            if value is not None:
                tags = tags.withColumn(column, F.when(F.col("id") == tag_id, F.lit(value)).otherwise(F.col(column)))
        self._rewrite(row.domain_id, tags=tags)

    def update_document(self, document_id: int, labels: list[str] | None = None, subdomain: str | None = None, clear_subdomain: bool = False) -> None:
        """New labels or another topic, for the document and its chunks."""
        row = self.get("documents", document_id)
        d = row.domain_id
        tags = list(self.get_or_create_tags(d, labels).values()) if labels is not None else None
        sub = self.get_or_create_subdomains(d, [subdomain])[subdomain] if subdomain is not None else None
        changed = {}
        for name, key in (("documents", "id"), ("chunks", "document_id")):
            df, this = self.table(name, [d]), F.col(key) == document_id
            if tags is not None:
                df = df.withColumn("tags", F.when(this, F.array(*(F.lit(t).cast("long") for t in tags)).cast("array<bigint>")).otherwise(F.col("tags")))
            if sub is not None or clear_subdomain:
                df = df.withColumn("subdomain_id", F.when(this, F.lit(None if clear_subdomain else sub).cast("long")).otherwise(F.col("subdomain_id")))
            changed[name] = df
        self._rewrite(d, **changed)

    def reindex_domain(self, domain_id: int, model: str | None = None) -> int:
        """Embed all chunks again, by another model if one is given; how many."""
        domain = self.get("domains", domain_id)
        model = model or domain.model
        if model not in self.embedders:
            raise ValueError(f"no embedder for {model!r}")
        base, this = self.store.version(), F.col("id") == domain_id
        domains = self.table("domains").withColumn("model", F.when(this, F.lit(model)).otherwise(F.col("model"))).withColumn("dim", F.when(this, F.lit(MODELS[model][0])).otherwise(F.col("dim")))
        self.store.commit({"domains": domains, "embeddings": self._embedded(self.table("chunks", [domain_id]), model)}, domain_id, base=base)
        return self.table("embeddings", [domain_id]).count()

    # reading

    def corpus(self, domain_ids: list[int]) -> DataFrame:
        """Chunks with their embeddings."""
        return with_vectors(*self._parts(domain_ids))

    def _parts(self, domain_ids: list[int]) -> tuple[DataFrame, DataFrame]:
        """Chunks, and their embeddings."""
        return self.table("chunks", domain_ids).withColumnRenamed("id", "chunk_id"), self.table("embeddings", domain_ids).select("domain_id", "chunk_id", "embedding")

    def queries(self, model: str, texts: list[str | None], vectors: list[list[float] | None] | None = None) -> DataFrame:
        """(query_id, text, vector): numbered from 0; a text without a vector is embedded, unless it was lately."""
        vectors = vectors or [None] * len(texts)
        fresh = list(dict.fromkeys(t for t, v in zip(texts, vectors) if t is not None and v is None and (model, t) not in self._vectors))
        found = {}
        if fresh:
            rows = self.spark.createDataFrame([(t,) for t in fresh], "text string").select("text", self.embedders[model](F.col("text")).alias("v")).collect()
            found = {(model, r.text): r.v for r in rows}
        known = [v if v is not None else found.get((model, t)) or self._vectors.get((model, t)) for t, v in zip(texts, vectors)]
        for t in texts:  # the least lately asked goes first
            if t is not None and (key := (model, t)) in (found.keys() | self._vectors.keys()):
                self._vectors[key] = found.get(key) or self._vectors.pop(key)
        while len(self._vectors) > REMEMBERED:
            self._vectors.popitem(last=False)
        return self.spark.createDataFrame([(k, t, v) for k, (t, v) in enumerate(zip(texts, known))], "query_id long, text string, vector array<float>")

    def search(self, domain_id: int, text: str | None = None, vector: list[float] | None = None, k: int = 10, labels: list[str] | None = None, match_all: bool = False,
               document_ids: list[int] | None = None, subdomain: str | None = None, filter: str | None = None, diversity: float = 0.0) -> DataFrame:
        """The hits of one query in one domain, by text, by vector, or by both."""
        domain = self.get("domains", domain_id)
        if text is None and vector is None:
            raise ValueError("a query takes a text or a vector")
        if vector is not None and len(vector) != domain.dim:
            raise ValueError(f"the vector has {len(vector)} parts, the domain {domain.dim}")
        subs = self.subdomain_ids(domain_id) if subdomain is not None else {}
        allowed = request_filter(labels, match_all, document_ids, subs.get(subdomain), subdomain is None or subdomain in subs, filter, self.tag_ids(domain_id))
        asked = self.queries(domain.model, [text], [vector])
        began = time.monotonic()
        chunks, vectors = self._parts([domain_id])
        hits = search(chunks, asked, k, allowed, diversity, self.reranker, index=self.index, vectors=vectors).orderBy("rank")
        self.counts.update(searches=1, search_ms=int(1000 * (time.monotonic() - began)))
        return hits

    def search_multi(self, domain_ids: list[int], text: str | None = None, vector: list[float] | None = None, k: int = 10, filter: str | None = None, diversity: float = 0.0) -> DataFrame:
        """The best hits of several domains of one model, by raw score; a domain named twice counts once."""
        rows = [self.get("domains", d) for d in dict.fromkeys(domain_ids)]
        if len({(r.model, r.dim) for r in rows}) > 1:
            raise ValueError("the domains have different models")
        hits = None
        for r in rows:
            found = self.search(r.id, text, vector, k, filter=filter, diversity=diversity)
            hits = found if hits is None else hits.unionByName(found)
        if hits is None:
            return self.spark.createDataFrame([], "domain_id long, query_id long, chunk_id long, score double, text string, snippet string, rank int")
        return merge_domains(hits, k).orderBy("rank")

    def chunk_context(self, chunk_id: int, before: int = 1, after: int = 1) -> DataFrame:
        """The chunks around one, in document order."""
        row = self.get("chunks", chunk_id)
        chunks = self.table("chunks", [row.domain_id])
        near = (F.col("document_id") == row.document_id) & F.col("ordinal").between(row.ordinal - before, row.ordinal + after)
        return chunks.where(near).orderBy("ordinal")
