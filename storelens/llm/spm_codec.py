"""SentencePiece BPE encoding by a prefix table, and decoding (operator 4).

For every prefix of a text the BPE result ends in exactly one token. The
table stores that token: an Aho-Corasick automaton lists the pieces that end
at each position, and the one whose pair with the last token of the prefix
before it is *compatible* (BPE of the two pieces' text gives just these two)
is the last token. Ids are then read backwards from the end of the table.
The work per text is linear in its length.

Texts are cut only where no piece spans the cut (before white space that
starts a word, and around line breaks), so the parts are independent, and
recurring parts are looked up in a bounded memo.

Defined results: null and empty texts give the end id alone and decode to
the empty text; U+2581 decodes to a space, as the library does; characters
without a piece become byte pieces. Extra columns are not carried over.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storelens.llm.common import map_text, table

SPACE = "▁"


class _Memo(dict):
    """A dict that works out missing entries; ``make`` decides what is kept."""

    def __init__(self, make: Callable[[str], tuple[str, str]]):
        super().__init__()
        self.make = make

    def __missing__(self, key: str) -> tuple[str, str]:
        return self.make(key)


class PrefixTableBPE:
    """Encoder and decoder for a SentencePiece BPE model with byte fallback."""

    def __init__(self, model_file: str, memo_size: int = 300_000):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = sp.get_piece_size()
        self.eos = sp.eos_id()
        self.piece = [sp.id_to_piece(i) for i in range(n)]
        self.byte_id, self.byte_of, self.rank, self.ids = [0] * 256, {}, {}, {}
        for i, p in enumerate(self.piece):
            if sp.is_byte(i):
                self.byte_id[int(p[3:5], 16)] = i
                self.byte_of[i] = int(p[3:5], 16)
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.ids[p] = i
                self.rank[p] = -sp.get_score(i)
        self.plain = [None if i in self.byte_of else p.replace(SPACE, " ") for i, p in enumerate(self.piece)]
        self.digits = [str(i) for i in range(n)]
        self.automaton = ahocorasick.Automaton()
        for p, i in self.ids.items():
            self.automaton.add_word(p, (i, len(p)))
        self.automaton.make_automaton()
        chars = {c for p in self.ids for c in p}
        inner = any(SPACE in p.lstrip(SPACE) for p in self.ids)
        cut = r"\n" if "\n" not in chars else ""
        # parts that no piece crosses; one part if pieces could hold a space after other characters
        self.parts = re.compile(f"{SPACE}*[^{SPACE}{cut}]+|{SPACE}+" + (f"|{cut}" if cut else "")
                                if not inner else r"(?s).+")
        self.memo_size = memo_size
        self.start_mark = n
        self.memo = _Memo(self.part)
        self.pairs: dict[int, bool] = {}
        self.logs: dict[int, list | None] = {}

    def _merge_log(self, token: int) -> list | None:
        """The merges that build a piece: (rank, first symbol, last symbol) after each; None if BPE
        does not give the piece back. The first entry is the state before any merge."""
        if token in self.logs:
            return self.logs[token]
        sym = list(self.piece[token])
        log = [(float("-inf"), sym[0], sym[-1])]
        while len(sym) > 1:
            best, at = float("inf"), -1
            for k in range(len(sym) - 1):
                r = self.rank.get(sym[k] + sym[k + 1])
                if r is not None and (at < 0 or r < best):
                    best, at = r, k
            if at < 0:
                break
            sym[at:at + 2] = [sym[at] + sym[at + 1]]
            log.append((best, sym[0], sym[-1]))
        self.logs[token] = log = log if len(sym) == 1 else None
        return log

    def _compatible(self, key: int) -> bool:
        """Whether BPE of the two pieces' text (left << 20 | right) gives exactly these two pieces;
        with START on the left, whether the right piece alone gives itself."""
        left, right = key >> 20, key & 0xFFFFF
        if left == self.start_mark:
            known = self._merge_log(right) is not None
        else:
            known = self._no_cross_merge(self._merge_log(left), self._merge_log(right))
        if len(self.pairs) < 2 * self.memo_size:
            self.pairs[key] = known
        return known

    def _no_cross_merge(self, a: list | None, b: list | None) -> bool:
        if a is None or b is None:
            return False
        i = j = 0
        while True:
            cross = self.rank.get(a[i][2] + b[j][1])
            ra = a[i + 1][0] if i + 1 < len(a) else None
            rb = b[j + 1][0] if j + 1 < len(b) else None
            # equal ranks: the leftmost merge goes first, that is a's, then the crossing one, then b's
            if cross is not None and (ra is None or cross < ra) and (rb is None or cross <= rb):
                return False
            if ra is None and rb is None:
                return True
            if rb is None or (ra is not None and ra <= rb):
                i += 1
            else:
                j += 1

    def encode_part(self, s: str) -> list[int]:
        """Ids of one part, from its prefix table."""
        n, mark = len(s), self.start_mark
        last, start = [mark] * (n + 1), [0] * (n + 1)
        known, compatible = self.pairs.get, self._compatible
        seen = 0  # the last prefix with an entry
        for end, (t, size) in self.automaton.iter(s):
            if end < seen:
                continue
            for k in range(seen, end):  # characters without a piece: no merge can touch them
                start[k + 1] = k
            seen = end
            key = last[end + 1 - size] << 20 | t
            ok = known(key)
            if compatible(key) if ok is None else ok:
                seen = end + 1
                last[seen], start[seen] = t, seen - size
        for k in range(seen, n):
            start[k + 1] = k
        out: list[int] = []
        k = n
        while k:
            j = start[k]
            if last[k] != mark:
                out.append(last[k])
            else:
                out.extend(self.byte_id[b] for b in reversed(s[j:k].encode("utf-8")))
            k = j
        out.reverse()
        return out

    def decode_part(self, ids: list[int]) -> str:
        """Text of ids: pieces with spaces for their marks, runs of byte pieces as UTF-8."""
        out = list(map(self.plain.__getitem__, ids))
        if None in out:  # byte pieces
            out, raw = [], bytearray()
            for i in ids:
                if i in self.byte_of:
                    raw.append(self.byte_of[i])
                    continue
                out += [raw.decode("utf-8", "replace"), self.plain[i]]
                raw.clear()
            out.append(raw.decode("utf-8", "replace"))
        return "".join(out)

    def part(self, s: str) -> tuple[str, str]:
        """(ids joined by spaces, decoded text) of one part."""
        ids = self.encode_part(s)
        got = " ".join(map(self.digits.__getitem__, ids)), self.decode_part(ids)
        if len(s) <= 48 and len(self.memo) < self.memo_size:
            self.memo[s] = got
        return got

    def code(self, text: str | None) -> tuple[str, str]:
        """(ids joined by spaces with the end id, text decoded from them)."""
        if not text:
            return str(self.eos), ""
        got = list(map(self.memo.__getitem__, self.parts.findall(SPACE + text.replace(" ", SPACE))))
        ids = " ".join(map(itemgetter(0), got))
        return f"{ids} {self.eos}", "".join(map(itemgetter(1), got))[1:]

    def encode(self, text: str | None) -> list[int]:
        return [int(x) for x in self.code(text)[0].split()]

    def decode(self, ids: list[int]) -> str:
        return self.decode_part([i for i in ids if i != self.eos])[1:]


_CODECS: dict[tuple[str, int], PrefixTableBPE] = {}


def codec(model_file: str, memo_size: int = 300_000) -> PrefixTableBPE:
    """One encoder per Python worker and model."""
    key = (model_file, memo_size)
    if key not in _CODECS:
        _CODECS[key] = PrefixTableBPE(model_file, memo_size)
    return _CODECS[key]


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def spm_encode(docs: DataFrame, model_file: str | None = None, keep: tuple[str, ...] = ("doc_id",),
               text_col: str = "text", memo_size: int = 300_000) -> DataFrame:
    """``keep`` columns plus ids array<int> and decoded string. Map-only: no shuffle."""
    model = model_file or default_model()

    def fn(texts: pa.Array) -> list:
        c = codec(model, memo_size)
        ids, back = [], []
        for t in texts:
            joined, text = c.code(t.as_py())
            ids.append(np.fromstring(joined, np.int32, sep=" "))
            back.append(text)
        ends = np.concatenate(([0], np.cumsum([len(x) for x in ids])))
        return [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(ids))), pa.array(back, pa.string())]

    return map_text(docs, "ids array<int>, decoded string", fn, list(keep), text_col)


def spm_digest(docs: DataFrame, model_file: str | None = None, keep: tuple[str, ...] = ("doc_id",),
               text_col: str = "text", memo_size: int = 300_000) -> DataFrame:
    """``keep`` columns plus n_tokens and the digests of ids and of the decoded text."""
    model = model_file or default_model()
    sha: Callable[[str], str] = lambda s: hashlib.sha256(s.encode("utf-8")).hexdigest()

    def fn(texts: pa.Array) -> list:
        c = codec(model, memo_size)
        n, a, b = [], [], []
        for t in texts:
            ids, back = c.code(t.as_py())
            n.append(ids.count(" ") + 1)
            a.append(sha(ids))
            b.append(sha(back))
        return [pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]

    return map_text(docs, "n_tokens long, ids_sha256 string, decoded_sha256 string", fn, list(keep), text_col)


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spm_digest(table(spark, sf_dir, "documents").select("doc_id", F.col("text")))


def spm_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: ids of every document; the text is dropped once it decodes from them."""
    # a smaller memo than alone: the workers also hold what the stages before have loaded
    encoded = spm_encode(docs, keep=("doc_id", "lang", "source", "text"), memo_size=100_000)
    same = F.col("decoded") == F.regexp_replace(F.coalesce("text", F.lit("")), SPACE, " ")
    return encoded.select("doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_tokens"),
                          same.alias("round_trip"))
