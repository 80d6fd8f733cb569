"""Derived tables: postings, and the vector table with its key merges."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillwork.functions.text import tokens
from rillwork.tables import spread, written

#: Tokens that are broadcast, at most.
BROADCAST_TOKENS = 1_000_000


def embed_text(df: DataFrame, context: str = "context", content: str = "content"):
    """What is indexed or embedded of a chunk: context and content with a blank line between, or content alone."""
    has = F.col(context).isNotNull() & (F.col(context) != "")
    return F.when(has, F.concat(F.col(context), F.lit("\n\n"), F.col(content))).otherwise(F.col(content))


def postings(chunks: DataFrame, text: str = "content") -> DataFrame:
    """chunk_id, token and pos from 1. The tokeniser stands inside the generator: as a column of its own the optimiser
    would copy it into filters that it infers."""
    return _postings(chunks, tokens(F.col(text)))


def postings_of(rows: DataFrame) -> DataFrame:
    """Postings of rows that have words, a chunk's tokens."""
    return _postings(rows, F.col("words"))


def _postings(rows: DataFrame, words: Column) -> DataFrame:
    posts = rows.select("chunk_id", F.posexplode(words).alias("p", "token"))
    return posts.select("chunk_id", "token", (F.col("p") + 1).cast("long").alias("pos"))


@dataclass(frozen=True)
class TextIndex:
    """A full-text index for one search: postings (chunk_id, token, pos) and lengths (chunk_id, dl). What a search asks of
    it, and of a StoredIndex, are lengths, totals(), holding() and by_chunk(). words (chunk_id, words), if given, are the chunks'
    tokens in order."""

    postings: DataFrame
    lengths: DataFrame
    words: DataFrame | None = None

    @classmethod
    def passing(cls, chunks: DataFrame, text: str = "content") -> TextIndex:
        """Words are written once, and lengths and postings are read from them, unsorted."""
        rows = written(spread(chunks.select("chunk_id", text)).select("chunk_id", tokens(F.coalesce(F.col(text), F.lit(""))).alias("words")), "words")
        return cls(postings_of(rows), rows.select("chunk_id", F.size("words").cast("long").alias("dl")), rows)

    def totals(self) -> tuple[int, int]:
        """Chunks, and tokens of all chunks."""
        return tuple(self.lengths.agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first())

    def holding(self, wanted: DataFrame) -> DataFrame:
        """token, chunk_id and positions, in order, of the wanted tokens."""
        found = self.postings.join(few_tokens(wanted), "token", "left_semi")
        return found.groupBy("token", "chunk_id").agg(F.array_sort(F.collect_list(F.col("pos").cast("int"))).alias("positions"))

    def by_chunk(self) -> DataFrame:
        """chunk_id and words, its tokens in order."""
        if self.words is not None:
            return self.words
        places = self.postings.groupBy("chunk_id").agg(F.array_sort(F.collect_list(F.struct("pos", "token"))).alias("p"))
        return places.select("chunk_id", F.col("p.token").alias("words"))

    def without(self, chunk_ids: DataFrame) -> TextIndex:
        """The index without some chunks."""
        return TextIndex(*(x if x is None else x.join(chunk_ids, "chunk_id", "left_anti") for x in (self.postings, self.lengths, self.words)))


def few_tokens(wanted: DataFrame) -> DataFrame:
    """A written table of tokens, broadcast while they are few."""
    return F.broadcast(wanted) if wanted.count() <= BROADCAST_TOKENS else wanted


def contextual(chunks: DataFrame) -> DataFrame:
    """Chunks that have a context, with it before their content."""
    has = chunks.where(F.col("context").isNotNull())
    return has.withColumn("content", F.concat_ws("\n\n", "context", "content"))


def vector_upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of new in place of rows of old with their chunk_id. Of repeated ids in new, one row stays."""
    return old.join(new, "chunk_id", "left_anti").unionByName(new.dropDuplicates(["chunk_id"]))


def vector_delete(vectors: DataFrame, ids: DataFrame) -> DataFrame:
    return vectors.join(ids, "chunk_id", "left_anti")


def vector_fetch(vectors: DataFrame, ids: DataFrame, payload: bool = True, embedding: bool = False) -> DataFrame:
    """Points by id; columns that aren't asked for are never read."""
    drop = ["tags", "label", "document_id", "chunk_index"] * (not payload) + ["embedding"] * (not embedding)
    return vectors.drop(*drop).join(ids.select("chunk_id").distinct(), "chunk_id", "left_semi")


def payload_update(vectors: DataFrame, updates: DataFrame) -> DataFrame:
    """New tags for some ids."""
    return vectors.join(updates.select("chunk_id", F.col("tags").alias("new_tags")), "chunk_id", "left").withColumn("tags", F.coalesce("new_tags", "tags")).drop("new_tags")


def dim_violations(vectors: DataFrame, dim: int) -> DataFrame:
    """Ids whose vector hasn't the dimension."""
    return vectors.where(F.coalesce(F.size("embedding"), F.lit(-1)) != dim).select("chunk_id", F.size("embedding").cast("long").alias("dim"))


def filter_vectors(vectors: DataFrame, document_id: int | None = None, tags: list[str] | str | None = None) -> DataFrame:
    """Equality on the document and any-of on tags; a string counts as a list of one."""
    if document_id is not None:
        vectors = vectors.where(F.col("document_id") == document_id)
    if tags:
        vectors = vectors.where(F.arrays_overlap("tags", F.array(*map(F.lit, [tags] if isinstance(tags, str) else tags))))
    return vectors
