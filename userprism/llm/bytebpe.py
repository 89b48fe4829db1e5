"""Byte-level BPE by prefix dynamic programming.

Every prefix of a piece has one valid encoding, and that is the encoding of an earlier prefix
plus one last token. So one number per prefix, its last token, is the whole table: the encoding
of any prefix is read backwards from it, an append only adds entries, and an edit keeps the
entries before it. A last token is valid after another if merging their bytes by rank would
give the two back, which is decided by undoing their merges along the shared edge.

``PATTERN`` cuts a text into pieces that are encoded separately. Defined results: a null or
empty text has no tokens; equal texts have equal tokens; rows, ids and order of the input stay
as they are, extra columns are not read.
"""

import base64
import hashlib
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import caches

NEVER = 1 << 60


class Vocabulary:
    """Ranks of a tiktoken file, and what is derived from them."""

    def __init__(self, ranks):
        self.ranks = ranks
        self.bytes = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes[rank] = token
        self.names = [str(i) for i in range(len(self.bytes))]
        self.longest = max(map(len, ranks))
        self._parts, self._fits = {}, {}

    @classmethod
    def load(cls, path):
        with open(path, "rb") as file:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, file)})

    def merge(self, data, below=NEVER):
        """Merge single bytes by rank, lowest and leftmost first, using ranks under ``below``."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            found = [self.ranks.get(a + b, NEVER) for a, b in zip(parts, parts[1:])]
            best = min(found)
            if best >= below:
                break
            at = found.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def parts(self, token):
        """The two tokens whose merge makes this one; () for a byte, None if merges never make it."""
        known = self._parts.get(token, self)
        if known is self:
            data = self.bytes[token]
            merged = self.merge(data, token) if len(data) > 1 else []
            known = tuple(self.ranks[p] for p in merged) if len(merged) in (0, 2) else None
            self._parts[token] = known
        return known

    def fits(self, a, b):
        """Whether b may follow a: no merge crosses their border before each is complete."""
        key = a << 32 | b
        known = self._fits.get(key)
        if known is None:
            if len(self._fits) > 1_000_000:
                self._fits.clear()
            known = self._fits[key] = self._decide(a, b)
        return known

    def _decide(self, a, b):
        # Backwards in time: each edge token is merged away at its own next rank.
        a_until = b_until = NEVER
        while True:
            across = self.ranks.get(self.bytes[a] + self.bytes[b], NEVER)
            if across < a_until and across <= b_until:  # at equal ranks the left place merges first
                return False
            a_parts, b_parts = self.parts(a), self.parts(b)
            if not a_parts and not b_parts:
                return True
            if a_parts and (not b_parts or a > b):
                a_until, a = a, a_parts[1]
            else:
                b_until, b = b, b_parts[0]

    def prefix_table(self, data, table=None):
        """Last token of each prefix of ``data``; a table of a shorter prefix is carried on."""
        table = table or [None]
        get, fits, longest = self.ranks.get, self.fits, self.longest
        for end in range(len(table), len(data) + 1):
            for start in range(max(0, end - longest), end):
                token = get(data[start:end])
                if token is None or start and not fits(table[start], token):
                    continue
                if self.parts(token) is not None:
                    table.append(token)
                    break
        return table

    def read(self, table):
        """Tokens of the longest prefix of a table."""
        at, out = len(table) - 1, []
        while at:
            out.append(table[at])
            at -= len(self.bytes[table[at]])
        return out[::-1]

    def encode_piece(self, data):
        whole = self.ranks.get(data)  # a piece that is a token stays one, however merges would go
        return (whole,) if whole is not None else tuple(self.read(self.prefix_table(data)))

    def decode(self, tokens):
        return b"".join([self.bytes[t] for t in tokens])


class Encoder:
    """Encodes whole texts; tokens of recent pieces of up to ``LONGEST`` characters are kept,
    twice ``keep`` of them at most."""

    LONGEST = 48

    def __init__(self, vocabulary, pattern, keep=500_000):
        self.vocabulary, self.keep = vocabulary, keep
        self.split = regex.compile(pattern).findall
        self._new, self._old = {}, {}

    def piece(self, text):
        tokens = self._old.get(text)
        if tokens is None:
            tokens = self.vocabulary.encode_piece(text.encode())
        if len(text) <= self.LONGEST:
            if len(self._new) >= self.keep:
                self._new, self._old = {}, self._new
            self._new[text] = tokens
        return tokens

    def encode(self, text):
        get, make = self._new.get, self.piece
        out = []
        for p in self.split(text):
            tokens = get(p)
            if tokens is None:
                tokens = make(p)
                get = self._new.get
            out.append(tokens)
        return list(chain.from_iterable(out))


class EditableText:
    """A text with its prefix tables, kept exact under appends and edits.

    Only pieces from the one before the change up to the first old piece border behind it are
    cut again; the first changed piece keeps its table up to the changed byte.
    """

    def __init__(self, encoder, text=""):
        self.encoder = encoder
        self.text, self.pieces, self.tables = text, [], []
        self._rebuild(0, len(text), 0)

    def _rebuild(self, first, changed_to, shift):
        """Cut from piece ``first`` on until a border behind ``changed_to`` is an old border."""
        vocabulary = self.encoder.vocabulary
        at = sum(map(len, self.pieces[:first]))
        borders, place = {}, at
        for i in range(first, len(self.pieces)):
            borders[place + shift] = i
            place += len(self.pieces[i])
        new, tables, end = [], [], len(self.pieces)
        while at < len(self.text):
            if at >= changed_to and at in borders and at - 1 >= changed_to:
                end = borders[at]
                break
            size = 4096
            while True:  # a piece may reach beyond what was looked at
                found = self.encoder.split(self.text[at : at + size])
                if len(found) > 1 or at + size >= len(self.text):
                    break
                size *= 2
            piece = found[0]
            data, old = piece.encode(), self.pieces[first + len(new)] if first + len(new) < len(self.pieces) else ""
            same = 0
            kept = None
            if old:
                was = old.encode()
                while same < min(len(was), len(data)) and was[same] == data[same]:
                    same += 1
                kept = self.tables[first + len(new)][: same + 1]
            tables.append(vocabulary.prefix_table(data, kept))
            new.append(piece)
            at += len(piece)
        self.pieces[first:end] = new
        self.tables[first:end] = tables

    def replace(self, start, end, text):
        place = first = 0
        while first < len(self.pieces) and place + len(self.pieces[first]) < start:
            place += len(self.pieces[first])
            first += 1
        self.text = self.text[:start] + text + self.text[end:]
        self._rebuild(max(0, first - 1), start + len(text), len(text) - (end - start))

    def append(self, text):
        self.replace(len(self.text), len(self.text), text)

    def tokens(self):
        v = self.encoder.vocabulary
        whole = [v.ranks.get(p.encode()) for p in self.pieces]
        return [t for w, table in zip(whole, self.tables) for t in ([w] if w is not None else v.read(table))]


def encoder(path, pattern):
    """The encoder of this process for a vocabulary file."""
    return caches.hold(("bytes", path, pattern), lambda: Encoder(Vocabulary.load(path), pattern))


def encode(docs, path, pattern, id="doc_id", text="text"):
    """One row (id, tokens) per row of ``docs``."""
    def make(batches):
        run = encoder(path, pattern)
        for batch in batches:
            tokens = [run.encode(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tokens, pa.list_(pa.int32()))], names=[id, "tokens"])

    schema = T.StructType([docs.schema[id], T.StructField("tokens", T.ArrayType(T.IntegerType()))])
    return docs.select(id, text).mapInArrow(make, schema)


def decode(tokens, path, pattern, id="doc_id"):
    """One row (id, text) per row (id, tokens); bytes that are no UTF-8 become U+FFFD."""
    def make(batches):
        run = encoder(path, pattern).vocabulary
        for batch in batches:
            texts = [run.decode(t or ()).decode("utf-8", "replace") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id, "text"])

    schema = T.StructType([tokens.schema[id], T.StructField("text", T.StringType())])
    return tokens.select(id, "tokens").mapInArrow(make, schema)


def round_trip(docs, path, pattern):
    """Digests of the tokens and of the text decoded from them, one row per document."""
    def make(batches):
        run = encoder(path, pattern)
        names = run.vocabulary.names
        for batch in batches:
            counts, ids, texts = [], [], []
            for text in batch.column(1):
                tokens = run.encode(text.as_py() or "")
                counts.append(len(tokens))
                ids.append(hashlib.sha256(" ".join([names[t] for t in tokens]).encode()).hexdigest())
                texts.append(hashlib.sha256(run.vocabulary.decode(tokens)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(texts, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(
        make, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
