"""Byte-pair encoding and decoding with a minimal acyclic transducer as lexicon.

The words of all texts, the whole of each, are counted by Spark. The most frequent ``lexicon_words`` (a parameter: the lexicon's bound)
are encoded by exact merging and compiled into a minimal acyclic automaton: words share prefixes and suffixes, edges
carry numbers whose sum along a word is its place in the list of ids. Its arrays are one file that every executor
gets once and maps into memory, so its Python workers share the pages. Tasks look up the distinct words of a batch,
all at once, and merge those the lexicon lacks; each text's ids are then put together from its words.

The vocabulary is read from ``vocabulary`` (a path that the driver can read); nothing is trained. Texts are encoded as
the vocabulary's normalizer, pattern and merges say; special strings in a text become their own ids.

Defined results: a null or empty text has no ids and decodes to the empty text; repeated rows are encoded one by one;
a null doc_id is passed on; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from collections import Counter
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from carepath.llm.common import stored, texts
from carepath.session import new_folder

LEXICON_WORDS = 131_072
# Bounds of what one worker holds, not of what is encoded: a full store is emptied, a batch is done in parts.
WORKER_WORDS = 400_000
PART_TEXTS = 200
SHORT = 64
WORD_END = "</w>"
# Fixed value: the vocabulary's word pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"


def byte_letters() -> list[str]:
    """The printable stand-in of each byte: itself where it shows, else the next free code point from 256."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(free)) for b in range(256)]


class Vocabulary:
    """Tokens and merge ranks of a vocabulary file."""

    def __init__(self, specification: dict):
        model = specification["model"]
        self.ids: dict[str, int] = dict(model["vocab"])
        self.ranks = {tuple(m if isinstance(m, list) else m.split(" ")): k for k, m in enumerate(model["merges"])}
        self.special = {t["content"]: t["id"] for t in specification.get("added_tokens", ())}
        self.tokens = {i: t for t, i in {**self.ids, **self.special}.items()}
        self.letters = byte_letters()

    def merge(self, word: str) -> tuple[int, ...]:
        """The ids of one normalized word: the lowest-ranked pair is joined first, leftmost first among equals."""
        parts = [self.letters[b] for b in word.encode()]
        parts[-1] += WORD_END
        parts = self._joined(parts) if len(parts) <= SHORT else self._joined_long(parts)
        return tuple(map(self.ids.__getitem__, parts))

    def _joined(self, parts: list[str]) -> list[str]:
        """Each step looks at all pairs: fast for words, quadratic."""
        rank, none = self.ranks.get, len(self.ranks)
        ranks = [rank(pair, none) for pair in zip(parts, parts[1:], strict=False)]
        while ranks:
            best = min(ranks)
            if best == none:
                break
            k = ranks.index(best)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            del ranks[k]
            if k:
                ranks[k - 1] = rank((parts[k - 1], parts[k]), none)
            if k < len(ranks):
                ranks[k] = rank((parts[k], parts[k + 1]), none)
        return parts

    def _joined_long(self, parts: list[str]) -> list[str]:
        """The same order of steps from a heap of pairs over a linked list, for words of any length."""
        size = len(parts)
        left, right = list(range(-1, size - 1)), list(range(1, size + 1))
        heap = [(self.ranks[pair], k) for k, pair in enumerate(zip(parts, parts[1:], strict=False)) if pair in self.ranks]
        heapify(heap)
        while heap:
            rank, k = heappop(heap)
            n = right[k]
            if parts[k] is None or n >= size or self.ranks.get((parts[k], parts[n])) != rank:
                continue  # one of the two has been joined meanwhile
            parts[k] += parts[n]
            parts[n] = None
            right[k] = right[n]
            if right[n] < size:
                left[right[n]] = k
            for a, b in ((left[k], k), (k, right[k])):
                if a >= 0 and b < size and (parts[a], parts[b]) in self.ranks:
                    heappush(heap, (self.ranks[parts[a], parts[b]], a))
        return [p for p in parts if p is not None]


class Splitter:
    """Cuts a text into normalized words and special strings."""

    def __init__(self, special: dict[str, int]):
        import regex

        self.special = special
        self.find = regex.compile(PATTERN).findall
        # the same pattern for texts of ASCII alone, where it is that of few classes
        blank = "".join(f"\\x{k:02x}" for k in range(128) if regex.fullmatch(r"\s", chr(k)))
        self.find_ascii = re.compile(rf"[a-z]+|'(?:[stmd]|re|ve|ll)|[0-9]|[^{blank}a-z0-9]+").findall
        self.cut = regex.compile("(" + "|".join(map(regex.escape, special)) + ")").split if special else None

    def words(self, text: str) -> list[str]:
        if self.cut is None or not any(s in text for s in self.special):
            return self._found(text)
        found = []
        for piece in self.cut(text):
            found += [piece] if piece in self.special else self._found(piece)
        return found

    def _found(self, text: str) -> list[str]:
        return self.find_ascii(text.lower()) if text.isascii() else self.find(_normal(text))


def _normal(text: str) -> str:
    # lower case character by character: a final capital sigma is no exception
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


def compile_lexicon(entries: dict[str, tuple[int, ...]]) -> dict:
    """The minimal acyclic automaton of the words as flat arrays, and their ids in the words' order.

    Words are added in byte order; a state that gets no more edges is replaced by an equal one that is already kept.
    """
    import numpy as np

    ordered = sorted((word.encode(), ids) for word, ids in entries.items())
    kept: dict[tuple, int] = {}
    states: list[tuple[bool, tuple]] = []

    def keep(final: bool, edges: list) -> int:
        key = (final, tuple(edges))
        if key not in kept:
            kept[key] = len(states)
            states.append(key)
        return kept[key]

    path: list[list] = [[False, []]]  # open states: final, edges
    labels = b""
    for word, _ in ordered:
        same = 0
        while same < len(labels) and same < len(word) and labels[same] == word[same]:
            same += 1
        for k in range(len(labels), same, -1):
            state = path.pop()
            path[-1][1].append((labels[k - 1], keep(*state)))
        path.extend([False, []] for _ in word[same:])
        path[-1][0] = True
        labels = word
    for k in range(len(labels), 0, -1):
        state = path.pop()
        path[-1][1].append((labels[k - 1], keep(*state)))
    root = keep(*path[0])
    below = [0] * len(states)  # children are kept before their parents
    edges = []
    for k, (final, outgoing) in enumerate(states):
        n = int(final)
        for label, target in outgoing:
            edges.append((k * 256 + label, target, n))
            n += below[target]
        below[k] = n
    edges.sort()
    flat = np.array(edges, np.int64).reshape(-1, 3)
    return {
        "root": np.array([root], np.int64),
        "keys": flat[:, 0].copy(),
        "targets": flat[:, 1].copy(),
        "adds": flat[:, 2].copy(),
        "finals": np.array([int(s[0]) for s in states], np.int64),
        "offsets": np.cumsum([0] + [len(ids) for _, ids in ordered]).astype(np.int64),
        "ids": np.array([i for _, ids in ordered for i in ids], np.int64),
    }


def pack(arrays: dict) -> bytes:
    """One file: a line that says where each array is, then the arrays."""
    import numpy as np

    names = ("root", "keys", "targets", "adds", "finals", "offsets", "ids")
    sizes = json.dumps([len(arrays[n]) for n in names])
    return sizes.ljust(256).encode() + b"".join(np.ascontiguousarray(arrays[n]).tobytes() for n in names)


class Lexicon:
    """A packed automaton mapped into memory."""

    def __init__(self, path: str):
        import numpy as np

        names = ("root", "keys", "targets", "adds", "finals", "offsets", "ids")
        with open(path, "rb") as f:
            sizes = json.loads(f.read(256))
        whole = np.memmap(path, np.int64, "r", offset=256, shape=(sum(sizes),))
        at = 0
        for name, size in zip(names, sizes, strict=True):
            setattr(self, name, whole[at : at + size])
            at += size

    def look_up(self, words: list[str]) -> list[tuple[int, ...] | None]:
        """The ids of each word, None for words the lexicon lacks; all words go one byte further at a time."""
        import numpy as np

        found: list = [None] * len(words)
        if not words or not len(self.keys):
            return found
        data = [w.encode() for w in words]
        lengths = np.fromiter(map(len, data), np.int64, len(data))
        starts = np.cumsum(lengths) - lengths
        flat = np.frombuffer(b"".join(data), np.uint8)
        active = np.arange(len(data))
        state = np.full(len(data), self.root[0], np.int64)
        place = np.zeros(len(data), np.int64)
        depth = 0
        while len(active):
            over = lengths[active] == depth
            for k, s in zip(active[over].tolist(), state[active[over]].tolist(), strict=True):
                if self.finals[s]:
                    n = place[k]
                    found[k] = tuple(self.ids[self.offsets[n] : self.offsets[n + 1]].tolist())
            active = active[~over]
            key = state[active] * 256 + flat[starts[active] + depth]
            edge = np.searchsorted(self.keys, key)
            there = (edge < len(self.keys)) & (self.keys[np.minimum(edge, len(self.keys) - 1)] == key)
            active, edge = active[there], edge[there]
            state[active] = self.targets[edge]
            place[active] += self.adds[edge]
            depth += 1
        return found


def word_counts(docs: DataFrame, special: dict[str, int]) -> DataFrame:
    """How often each normalized word occurs in all texts: counted in the task, then summed."""

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        split, found = Splitter(special), Counter()

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict(
                {"word": pa.array(list(found), pa.string()), "n": pa.array(list(found.values()), pa.int64())}
            )

        for batch in batches:
            for text in batch.column("text"):
                found.update(split.words(text.as_py()))
                if len(found) > WORKER_WORDS:
                    yield rows()
                    found.clear()
        if found:
            yield rows()

    return texts(docs).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(counts: DataFrame, most: int) -> DataFrame:
    """The words of the highest counts, at most ``most``; words of one count are all in or all out."""
    counts = stored(counts, "word-counts")
    sizes = counts.groupBy("n").agg(F.count(F.lit(1)).alias("words"))
    # rows of one count each: how many words have that count or a higher one
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("n"))
    reached = sizes.withColumn("reached", F.sum("words").over(order)).where(F.col("reached") <= most)
    least = reached.agg(F.min("n").alias("least")).first()["least"]
    return counts.where(F.col("n") >= (least if least is not None else F.lit(None)))


def read_vocabulary(path: str) -> Vocabulary:
    with open(path, encoding="utf-8") as f:
        return Vocabulary(json.load(f))


def share_lexicon(spark: SparkSession, docs: DataFrame, vocabulary: Vocabulary, lexicon_words: int) -> str:
    """Compile the lexicon of the corpus, write it to the shared folder; the name executors get the file by."""
    from pyarrow import fs

    frequent = frequent_words(word_counts(docs, vocabulary.special), lexicon_words).collect()
    entries = {r["word"]: vocabulary.merge(r["word"]) for r in frequent if r["word"] not in vocabulary.special}
    folder = new_folder(spark, "lexicon")
    name = folder.rsplit("/", 1)[1] + ".bin"
    store, base = fs.FileSystem.from_uri(folder)
    store.create_dir(base)
    with store.open_output_stream(f"{base}/{name}") as out:
        out.write(pack(compile_lexicon(entries)))
    spark.sparkContext.addFile(f"{folder}/{name}")
    return name


class Memory(dict):
    """Words to numbers, and by number a word's ids and their tokens; words met for the first time wait for theirs."""

    def __init__(self, special: dict[str, int]):
        super().__init__()
        self.special = special
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.new: list[str] = []
        self.ids, self.starts, self.sizes = array("i"), array("q"), array("q")
        self.decoded: list[str] = []

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        self.new.append(word)
        return number

    def learn(self, lexicon: Lexicon, book: Vocabulary) -> None:
        """Ids for the words that wait: special strings their own, others from the lexicon, the rest by merging."""
        for word, found in zip(self.new, lexicon.look_up(self.new), strict=True):
            ids = (self.special[word],) if word in self.special else found or book.merge(word)
            self.starts.append(len(self.ids))
            self.sizes.append(len(ids))
            self.ids.extend(ids)
            self.decoded.append(" ".join(map(book.tokens.__getitem__, ids)))
        self.new = []

    def spread(self, numbers: list[int]) -> tuple:
        """The ids of the words one after the other, and where each word's begin (one entry more than words)."""
        import numpy as np

        words = np.array(numbers, np.int64)
        sizes = np.frombuffer(self.sizes, np.int64)[words] if numbers else words
        ends = np.concatenate([[0], np.cumsum(sizes)])
        if not numbers:
            return np.array([], np.int32), ends
        shift = np.frombuffer(self.starts, np.int64)[words] - ends[:-1]
        return np.frombuffer(self.ids, np.int32)[np.repeat(shift, sizes) + np.arange(ends[-1])], ends


_MEMORY: dict[str, Memory] = {}


def worker_memory(lexicon: str, special: dict[str, int]) -> Memory:
    """The words this worker process has met, kept from task to task for one lexicon."""
    if lexicon not in _MEMORY:
        _MEMORY.clear()
        _MEMORY[lexicon] = Memory(special)
    return _MEMORY[lexicon]


def encode(docs: DataFrame, vocabulary: str, lexicon_words: int = LEXICON_WORDS) -> DataFrame:
    """doc_id, ids, decoded: the ids of every text, and the tokens of these ids joined by one space."""
    spark = docs.sparkSession
    known = read_vocabulary(vocabulary)
    name = share_lexicon(spark, docs, known, lexicon_words)
    shared = spark.sparkContext.broadcast(known)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import SparkFiles

        book, lexicon = shared.value, Lexicon(SparkFiles.get(name))
        split = Splitter(book.special)
        memory = worker_memory(name, book.special)
        for batch in batches:
            for at in range(0, batch.num_rows, PART_TEXTS):
                part = batch.slice(at, PART_TEXTS)
                if len(memory) > WORKER_WORDS:
                    memory.forget()
                numbers, borders = [], [0]
                for t in part.column("text"):
                    numbers += map(memory.__getitem__, split.words(t.as_py()))
                    borders.append(len(numbers))
                memory.learn(lexicon, book)
                ids, ends = memory.spread(numbers)
                lists = pa.ListArray.from_arrays(pa.array(ends[borders], pa.int32()), pa.array(ids, pa.int32()))
                tokens = list(map(memory.decoded.__getitem__, numbers))
                decoded = [" ".join(tokens[a:b]) for a, b in zip(borders, borders[1:], strict=False)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), lists, pa.array(decoded, pa.string())], names=["doc_id", "ids", "decoded"]
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return texts(docs, "doc_id").mapInArrow(run, f"doc_id {kind}, ids array<int>, decoded string")


def digests(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded text."""
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
