"""Alignment of two tokenizers: how often tokens of one stand over the same bytes as tokens of the other, over a corpus.

Side A reads a space and the text, side B the text (and adds the space itself), so both cut the same bytes. Where tokens
of both end, a group ends; a link is an occurrence of an A and a B token whose byte ranges overlap. Between two
neighbouring ends of either side lies exactly one link, so links are the union of both sides' ends.

The corpus-wide part is a cogroup of postings. A document's links become its distinct id pairs and their multiplicities;
these postings are shuffled by their B id and sorted by (B id, A id), streams that Spark spills. There a pair's count
and the highest count of its B id are windows over the sorted stream; each posting then contributes its share to its
document, and contributions are summed by document, partially before they move.

A B id with more postings than an even share of the exchange (a very common token) isn't dealt to one task: its
postings are spread over cells by document, its pairs' counts are added up before they move, and cells are joined
with them. Such ids are at most as many as the exchange has partitions. Pairs of one B id are at most A's vocabulary.

Both tokenizers begin a token at a single space before a visible character, whatever stands around it, so texts are
encoded word by word and words are remembered. Words that a side doesn't give back byte for byte void their text.

Defined results: a text that is null, empty or not given back (U+2581 becomes a space) has zeros and an empty digest;
repeated rows, also of equal ids, are counted and returned each; texts are never cut short; no input, no rows; other
columns are never read. Ties for a B id's highest count are all best.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import scratch_table, text_rows
from gridloom.llm.kernels import slices
from gridloom.llm.token_counts import byte_letters, vocabulary_path

SIDE_A, SIDE_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: The mark that side B writes spaces as; a text that holds it reads back otherwise.
MARK = "▁"
#: Marks that may end a word, if a vocabulary lets them be told apart from it.
MARKS = ".,;:!?"
CUT = re.compile(r"(?<! ) (?=\S)")
#: Where blanks meet, or stand at an end: then not every space is a cut.
UNUSUAL = re.compile(r" \s|^\s| \Z")
#: Words and their characters remembered by a worker, beyond which it starts anew; bytes of text, and new words, at a time.
MEMO, MEMO_CHARS, SLICE, AT_ONCE, LINE = 300_000, 24 << 20, 1 << 20, 4096, 128
ID_BITS = 20
ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<struct<b: int, a: int, m: int>>"


def words_of(text: str) -> list[str]:
    """What follows the cuts of " " + text, without their space."""
    if not UNUSUAL.search(text):
        return text.split(" ")
    first, *rest = CUT.split(" " + text)
    return [first[1:], *rest] if first else rest


class Aligner:
    """Ids of both sides, groups and links of words, each word with a space before it."""

    def __init__(self, path_a: str, path_b: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import sentencepiece
        from tokenizers import Tokenizer

        self.side_a = Tokenizer.from_file(path_a)
        self.side_a.encode_special_tokens = True
        self.side_b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        letters = byte_letters()
        spelt = {i: bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode() for t, i in self.side_a.get_vocab().items()}
        self.bytes_a = [spelt.get(i, b"") for i in range(max(spelt) + 1)]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.side_b.IsByte(i) else p.replace(MARK, " ").encode() for i in range(self.side_b.vocab_size()) for p in (self.side_b.IdToPiece(i),)]
        #: Marks that no piece of B has behind a letter; A never joins them to one. After such, both sides begin anew.
        mixed = {p[k + 1] for i in range(self.side_b.vocab_size()) if not self.side_b.IsByte(i) for p in (self.side_b.IdToPiece(i),) for k in range(len(p) - 1) if p[k].isalpha()}
        self.marks = set(MARKS) - mixed
        self.width_a, self.width_b = (np.array([len(x) for x in each]) for each in (self.bytes_a, self.bytes_b))
        #: How an id is written where more of its side follow in the group, then where none do.
        self.written_a, self.written_b = (np.array([f"{i}{mark}" for mark in (",", last) for i in range(n)], object) for last, n in (("|", len(self.bytes_a)), (";", len(self.bytes_b))))
        self.reset()

    def reset(self) -> None:
        self.index: dict[str | tuple[str, str], int] = {}
        self.chars = 0
        self.groups: list[str] = []
        #: By word: its groups as text, tokens of each side and groups, and its first link (one more than words).
        self.sizes = np.zeros((3, 0), np.int64)
        self.first = np.zeros(1, np.int64)
        self.links = np.zeros(0, np.int64)
        for mark in sorted(self.marks):  # alone, as the word that it is not: without a space
            self.index["", mark] = len(self.groups)
            self._align(np.array(self.side_a.encode(mark, add_special_tokens=False).ids), np.array([self.side_b.PieceToId(mark)]), np.array([1]))

    def entries(self, words: list[str]) -> list:
        """Words, a mark at the end of one as an entry of its own."""
        marks, out = self.marks, []
        for w in words:
            if w[-1] in marks and w[-2:-1].isalpha():
                out += (w[:-1], ("", w[-1]))
            else:
                out.append(w)
        return out

    def learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.index]  # marks are there from the start
        self.chars += sum(map(len, new))
        alone = [w for w in new if w[0].isspace() or w[-1] == " "]  # their blanks would meet those of neighbours
        for w in alone:
            self._learn([w])
        if alone:
            new = list(set(new).difference(alone))
        for at in range(0, len(new), AT_ONCE):
            self._learn(new[at : at + AT_ONCE])

    def _learn(self, new: list[str]) -> None:
        """Words in one text, one after the other: both sides begin a token at each of them."""
        text = " ".join(new)
        lines = [" " + " ".join(new[at : at + LINE]) for at in range(0, len(new), LINE)]
        ids_a = list(chain.from_iterable(e.ids for e in self.side_a.encode_batch_fast(lines, add_special_tokens=False)))
        ids_b = self.side_b.encode(text)
        if b"".join(map(self.bytes_a.__getitem__, ids_a)) == b" " + text.encode() == b"".join(map(self.bytes_b.__getitem__, ids_b)):
            self.index.update(zip(new, range(len(self.groups), len(self.groups) + len(new)), strict=True))
            self._align(np.array(ids_a), np.array(ids_b), np.cumsum([1 + (len(w) if w.isascii() else len(w.encode())) for w in new]))
        elif len(new) == 1:
            self.index[new[0]] = -1
        else:
            self._learn(new[: len(new) // 2])
            self._learn(new[len(new) // 2 :])

    def _align(self, a: np.ndarray, b: np.ndarray, word_ends: np.ndarray) -> None:
        """Adds words that lie one after the other: their ends are ends of both sides."""
        ends_a, ends_b = np.cumsum(self.width_a[a]), np.cumsum(self.width_b[b])
        both = np.sort(np.concatenate((ends_a, ends_b)), kind="stable")
        again = both[1:] == both[:-1]
        ends, common = both[np.append(~again, True)], both[1:][again]
        links = b[np.searchsorted(ends_b, ends)] << ID_BITS | a[np.searchsorted(ends_a, ends)]
        self.links = np.concatenate((self.links, links))
        self.first = np.concatenate((self.first, self.first[-1] + np.searchsorted(ends, word_ends) + 1))
        upto = np.stack([np.searchsorted(e, word_ends) + 1 for e in (ends_a, ends_b, common)])
        self.sizes = np.concatenate((self.sizes, np.diff(upto, axis=1, prepend=0)), axis=1)
        # tokens in the order of groups, A's before B's; the last of a side in its group is written with another mark
        group_a, group_b = np.searchsorted(common, ends_a), np.searchsorted(common, ends_b)
        last_a, last_b = (np.append(g[1:] != g[:-1], True) for g in (group_a, group_b))
        order = np.argsort(np.concatenate((2 * group_a, 2 * group_b + 1)), kind="stable")
        written = np.concatenate((self.written_a[a + len(self.bytes_a) * last_a], self.written_b[b + len(self.bytes_b) * last_b]))[order].tolist()
        stops = np.cumsum([len(x) for x in written])[upto[0] + upto[1] - 1].tolist()
        whole = "".join(written)
        self.groups += [whole[i:j] for i, j in zip([0, *stops], stops, strict=False)]

    def rows(self, texts: list[str]) -> list[pa.Array]:
        """Columns of ALIGNED after doc_id."""
        if len(self.index) > MEMO or self.chars > MEMO_CHARS:
            self.reset()
        split = [self.entries(words_of(t)) if t and MARK not in t else [] for t in texts]
        self.learn(set(chain.from_iterable(split)))
        get = self.index.__getitem__
        split = [[] if -1 in own else own for own in (list(map(get, w)) for w in split)]
        offs = np.concatenate(([0], np.cumsum([len(w) for w in split])))
        word = np.fromiter(chain.from_iterable(split), np.int64, int(offs[-1]))
        sums = np.concatenate((np.zeros((3, 1), np.int64), np.cumsum(self.sizes[:, word], axis=1)), axis=1)
        n_a, n_b, n_groups = sums[:, offs[1:]] - sums[:, offs[:-1]]
        many = self.first[word + 1] - self.first[word]
        upto = np.concatenate(([0], np.cumsum(many)))
        place = np.arange(upto[-1]) + np.repeat(self.first[word] - upto[:-1], many)
        row = np.repeat(np.repeat(np.arange(len(texts)), np.diff(offs)), many)
        pair, m = np.unique(row << 2 * ID_BITS | self.links[place], return_counts=True)
        own = np.searchsorted(pair >> 2 * ID_BITS, np.arange(len(texts) + 1))
        low = (1 << ID_BITS) - 1
        pairs = pa.StructArray.from_arrays([pa.array(x, pa.int32()) for x in (pair >> ID_BITS & low, pair & low, m)], names=["b", "a", "m"])
        digests = [hashlib.sha256("".join(map(self.groups.__getitem__, w))[:-1].encode()).hexdigest() if w else "" for w in split]
        return [*(pa.array(x, pa.int64()) for x in (n_a, n_b, n_groups, upto[offs[1:]] - upto[offs[:-1]])), pa.array(digests, pa.string()), pa.ListArray.from_arrays(pa.array(own, pa.int32()), pairs)]


@cache
def aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


def aligned(batches: Iterator[pa.RecordBatch], a: str, b: str) -> Iterator[pa.RecordBatch]:
    both = aligner(vocabulary_path(a), vocabulary_path(b))
    for batch in batches:
        for part in slices(batch, "text", SLICE):
            yield pa.RecordBatch.from_arrays([part.column(0), *both.rows(part.column(1).to_pylist())], names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs"])


def uneven_sides(postings: DataFrame) -> DataFrame | None:
    """b, cells of the sides that have more postings than an even share of the exchange's partitions; None: there is none.

    The driver sees a count for each B id, at most B's vocabulary; what is left has less rows than there are partitions.
    """
    spark = postings.sparkSession
    counts = postings.groupBy("b").agg(F.count("*").alias("n")).collect()
    share = max(1, sum(r["n"] for r in counts) // int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = [(r["b"], -(-r["n"] // share)) for r in counts if r["n"] > share]
    return spark.createDataFrame(rows, "b int, cells int") if rows else None


def contributions(postings: DataFrame) -> DataFrame:
    """row, b, a, m -> row, m, k (the pair's count), best (the highest count of its B id)."""
    uneven = uneven_sides(postings)
    whole = postings if uneven is None else postings.join(F.broadcast(uneven), "b", "left_anti")
    counted = whole.repartition("b").withColumn("k", F.sum("m").over(Window.partitionBy("b", "a")))
    out = counted.select("row", "m", "k", F.max("k").over(Window.partitionBy("b")).alias("best"))
    if uneven is None:
        return out
    spread = postings.join(F.broadcast(uneven), "b").select("row", "b", "a", "m", F.pmod(F.xxhash64("row"), "cells").cast("int").alias("cell"))
    totals = postings.join(F.broadcast(uneven), "b", "left_semi").groupBy("b", "a").agg(F.sum("m").alias("k"))
    totals = totals.withColumn("best", F.max("k").over(Window.partitionBy("b"))).join(F.broadcast(uneven), "b")
    totals = totals.select("b", "a", "k", "best", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("cell"))
    return out.unionByName(spread.join(totals, ["b", "a", "cell"]).select("row", "m", "k", "best"))


def align_tokenizers(docs: DataFrame, side_a: str = SIDE_A, side_b: str = SIDE_B, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    encoded = text_rows(docs, id_col, text_col).mapInArrow(lambda it: aligned(it, side_a, side_b), ALIGNED)
    each = scratch_table(encoded.withColumn("row", F.monotonically_increasing_id()), "aligned")
    shares = contributions(each.select("row", F.inline("pairs"))).groupBy("row").agg(F.sum(F.when(F.col("k") == F.col("best"), F.col("m")).otherwise(0)).alias("n_best"), F.sum(F.col("k") * F.col("m")).alias("count_sum"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return each.drop("pairs").join(shares, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
