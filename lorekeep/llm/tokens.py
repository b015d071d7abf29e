"""Token ids of whole texts, with a cache of the pieces between spaces and lines.

In a byte-level vocabulary no token crosses the border before a space or a line
break that has other characters on both sides. Texts are cut there, each distinct
piece is encoded once by the tokenizers library and kept, and a text's ids are
those of its pieces in a row. Cutting, looking up and joining are done on whole
batches: pieces are numbered by Arrow's dictionary and ids gathered by numpy.

A special token's text in a document gives its id, as the library's default is;
with `plain_specials` it is ordinary text and gives ordinary ids.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc

from lorekeep.llm.shared import kept_by_worker

VOCABULARY = "byte_bpe_50k.json"
MARK = "\0"
#: Two white-space characters in a row (a border may lie inside the run), or the mark.
ODD = r"[\s\x0b\x1c-\x1f\x85\p{Z}]{2}|\x00"
CUT = re.compile(r"(?<=\S)(?=[ \n]\S)")
#: Characters of the pieces of one generation of the cache; a worker keeps two, and drops the older when the younger is full.
CACHED_CHARS = 2_000_000
#: Pieces that the library gets as one text.
TOGETHER = 1000

#: Texts to (ids of all of them in a row, number of ids of each).
Encoder = Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]


def vocabulary_path(name: str = VOCABULARY) -> str:
    return public_tokenizers.path(name)


def spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of every span, one span after another."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if max(total, int(starts.max(initial=0)) + total) < 1 << 31 else np.int64
    at = np.repeat((starts - (ends - sizes)).astype(kind), sizes)
    at += np.arange(total, dtype=kind)
    return at


class Cache:
    """Ids of pieces as little-endian unsigned 32-bit bytes; of what was not seen lately, the library's."""

    def __init__(self, path: str, plain_specials: bool) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = plain_specials
        added = {t.content for t in self.library.get_added_tokens_decoder().values()}
        self.specials = [] if plain_specials else sorted(added)
        vocabulary = self.library.get_vocab()
        # a character of a byte-level token stands for one byte
        self.bytes_of = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            self.bytes_of[i] = len(token.encode()) if token in added else len(token)
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.chars = 0

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        fast = getattr(self.library, "encode_batch_fast", self.library.encode_batch)
        return [np.array(e.ids, "<u4") for e in fast(texts, add_special_tokens=False)]

    def _fresh(self, pieces: list[str]) -> None:
        """Encode pieces that are not kept; many as one text where borders between them are safe."""
        joined, single = [], []
        for p in pieces:
            (joined if p[:1].isspace() and not p[-1].isspace() and not any(s in p for s in self.specials) else single).append(p)
        self.young.update(zip(single, [x.tobytes() for x in self._whole(single)], strict=True))
        groups = [joined[i : i + TOGETHER] for i in range(0, len(joined), TOGETHER)]
        for group, ids in zip(groups, self._whole(["".join(g) for g in groups]), strict=True):
            ends = np.cumsum([len(p.encode()) for p in group])
            reached = np.cumsum(self.bytes_of[ids])
            cut = np.searchsorted(reached, ends)
            if not np.array_equal(reached[cut], ends):
                raise ValueError("the vocabulary is not a byte-level one")
            raw, stops = ids.tobytes(), (4 * (cut + 1)).tolist()
            self.young.update(zip(group, [raw[a:b] for a, b in zip([0, *stops], stops, strict=False)], strict=True))
        self.chars += sum(map(len, pieces))

    def find(self, pieces: np.ndarray) -> list[bytes]:
        """The ids of distinct pieces."""
        if self.chars > CACHED_CHARS:
            self.old, self.young, self.chars = self.young, {}, 0
        found = list(map(self.young.get, pieces))
        if lacking := [i for i, raw in enumerate(found) if raw is None]:
            again = {p: raw for p in pieces[lacking] if (raw := self.old.get(p)) is not None}
            self.young.update(again)
            self.chars += sum(map(len, again))
            self._fresh([p for p in pieces[lacking] if p not in again] if again else pieces[lacking].tolist())
            for i, p in zip(lacking, pieces[lacking], strict=True):
                found[i] = self.young[p]
        return found


def cut(texts: pa.Array, specials: list[str]) -> tuple[pa.Array, np.ndarray]:
    """The pieces of all texts in a row, and the number of pieces of each text."""
    texts = texts.cast(pa.large_string()).fill_null("")
    odd = pc.match_substring_regex(texts, ODD)
    held = [pc.match_substring(texts, s) for s in specials]
    for h in held:
        odd = pc.or_(odd, h)
    marked = pc.replace_substring(pc.replace_substring(texts.filter(pc.invert(odd)), " ", MARK + " "), "\n", MARK + "\n")
    plain = pc.split_pattern(marked, MARK)
    flat, counts = plain.flatten(), pc.list_value_length(plain).to_numpy(zero_copy_only=False).astype(np.int64)
    if len(plain) == len(texts):
        return flat, counts
    others = [[t] if any(s in t for s in specials) else CUT.split(t) for t in texts.filter(odd).to_pylist()]
    odd = odd.to_numpy(zero_copy_only=False)
    all_counts, starts = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    all_counts[~odd], all_counts[odd] = counts, list(map(len, others))
    for rows, first in ((~odd, 0), (odd, len(flat))):
        starts[rows] = first + np.cumsum(all_counts[rows]) - all_counts[rows]
    flat = pa.concat_arrays([flat, pa.array([p for t in others for p in t], pa.large_string())])
    return flat.take(pa.array(spans(starts, all_counts))), all_counts


@kept_by_worker
def encoder(path: str, plain_specials: bool = False) -> Encoder:
    """A function from texts (null: empty) to their ids; one per worker, until it turns to other work."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    cache = Cache(path, plain_specials)

    def encode(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        pieces, counts = cut(texts, cache.specials)
        numbered = pieces.dictionary_encode()
        raw = cache.find(numbered.dictionary.to_numpy(zero_copy_only=False))
        sizes = np.fromiter(map(len, raw), np.int64, len(raw)) // 4
        at = numbered.indices.to_numpy(zero_copy_only=False)
        ids = np.frombuffer(b"".join(raw), "<u4")[spans((np.cumsum(sizes) - sizes)[at], sizes[at])]
        ends = np.concatenate(([0], np.cumsum(sizes[at])))
        stops = np.cumsum(counts)
        return ids, ends[stops] - ends[stops - counts]

    return encode


def slices(sizes: list[int], limit: int = 4 << 20) -> list[tuple[int, int]]:
    """Ranges of consecutive items of about `limit` in total, one item at least."""
    out, begin, total = [], 0, 0
    for i, n in enumerate(sizes):
        if i > begin and total + n > limit:
            out.append((begin, i))
            begin, total = i, 0
        total += n
    return [*out, (begin, len(sizes))] if sizes else []
