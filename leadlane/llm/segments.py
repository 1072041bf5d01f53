"""Token ids of whole texts by way of their space-delimited segments.

A tokenizer whose tokens never reach across a space that follows a visible character gives the same ids for a text
as for its segments one after another. Natural text repeats its segments, so a batch is cut by Arrow, its distinct
segments are encoded once, and the ids of the texts are gathered with numpy. Texts with runs of white space are
encoded whole, cut only at single spaces between visible characters once they grow long.
"""

from __future__ import annotations

import re
from array import array
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from leadlane.llm.common import one_thread, tokenizer_path

#: White space of Unicode, as a character class for RE2.
_WHITE = r"[\x{0009}-\x{000D}\x{001C}-\x{0020}\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
#: A space and visible characters, none of them the first of a special token.
_ONE_WORD = rf"\A {_WHITE.replace('[', '[^<')}+\z"
#: A space at either end of the text, or beside other white space in front of it.
IRREGULAR = rf"^ | $|{_WHITE} |\x01"
#: Runs that begin a token after an ASCII letter: no apostrophe, nothing of a special token, and no character that
#: composes with one after it.
_STOPS = r'[.,;:!?)\]}"#*$%&]+'
#: Put in front of a run of stops to mark that no space stood there; texts that hold it are encoded whole.
_MARK = "\x01"
_SAFE_CUT = re.compile(r"(?<=\S) (?=\S)")
#: Stands for a space in sentencepiece models, where it may join the spaces beside it.
_SPACE_PIECE = "▁"
#: Stands for the byte of a space in the tokens of byte tokenizers, and for no other byte.
_SPACE_BYTE = "Ġ"

#: Segments a worker remembers; beyond that it forgets those that came only once since it last did, and newer ones.
CACHE_SEGMENTS = 500_000
#: Texts given to the tokenizer at once.
BATCH_TEXTS = 1_000
#: Segments that make one text for the tokenizer.
JOINED_SEGMENTS = 24
#: Longer segments are encoded each time they come.
CACHE_CHARS = 48
#: Characters after which a text that has to be encoded whole is cut at the next safe place.
WHOLE_CHARS = 200_000

#: Where the ids of each segment begin, how many they are, and the ids.
Coded = tuple[np.ndarray, np.ndarray, np.ndarray]


def _view(numbers: array, kind) -> np.ndarray:
    return np.frombuffer(numbers, kind) if numbers else np.zeros(0, kind)


def _coded(lists: list[list[int]]) -> Coded:
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.cumsum(sizes) - sizes, sizes, np.fromiter(chain.from_iterable(lists), np.uint32, sizes.sum())


class SegmentEncoder:
    """``encode_many``: ids of texts; ``lead``: what stands before every segment but the first of a text.

    ``stops_apart`` says that a run of ``_STOPS`` after ASCII letters begins a token. Texts that match
    ``irregular`` are encoded whole, cut at ``safe_cut`` if they are long. ``encode_segments`` is a faster form of
    ``encode_many`` for distinct segments, if there is one, and returns them ``Coded``.
    """

    def __init__(self, encode_many, lead: str, stops_apart: bool, irregular: str = IRREGULAR, safe_cut: re.Pattern = _SAFE_CUT, encode_segments=None):
        self.encode_many, self.lead, self.stops_apart = encode_many, lead, stops_apart
        self.irregular, self.safe_cut = irregular, safe_cut
        self.encode_segments = encode_segments or (lambda segments: _coded(encode_many(segments)))
        self.place: dict[str, int] = {}
        self.starts, self.lengths, self.flat = array("q"), array("q"), array("I")
        self.again = np.zeros(0, bool)

    def _forget(self) -> None:
        """Keep only segments that were met again, the oldest if they are many; their ids move together."""
        again = np.zeros(len(self.starts), bool)
        again[: len(self.again)] = self.again
        kept = [(k, at) for k, at in self.place.items() if again[at]][: CACHE_SEGMENTS // 2]
        at = np.fromiter((at for _, at in kept), np.int64, len(kept))
        starts, sizes = _view(self.starts, np.int64)[at], _view(self.lengths, np.int64)[at]
        begins = np.cumsum(sizes) - sizes
        ids = _view(self.flat, np.uint32)[np.repeat(starts - begins, sizes) + np.arange(sizes.sum())]
        self.place = {k: i for i, (k, _) in enumerate(kept)}
        self.starts, self.lengths, self.flat = array("q", begins.tobytes()), array("q", sizes.tobytes()), array("I", ids.tobytes())
        self.again = np.zeros(len(kept), bool)

    def _add(self, coded: Coded) -> range:
        """Keep ids; returns where."""
        first = len(self.starts)
        starts, sizes, ids = coded
        self.starts.frombytes((len(self.flat) + starts).tobytes())
        self.lengths.frombytes(sizes.tobytes())
        self.flat.frombytes(ids.tobytes())
        return range(first, first + len(starts))

    def _places(self, keys: list[str]) -> np.ndarray:
        """Where the ids of each key are kept, after encoding those not met before."""
        place = self.place
        found = np.array(list(map(place.get, keys, repeat(-1))), np.int64)
        known = len(self.starts)
        if len(self.again) < known:
            self.again = np.concatenate([self.again, np.zeros(known - len(self.again), bool)])
        unmet = np.flatnonzero(found < 0)
        self.again[found[found >= 0]] = True
        if len(unmet):
            keys = [keys[i] for i in unmet.tolist()]
            missing = list(dict.fromkeys(keys))
            new = dict(zip(missing, self._add(self.encode_segments(missing))))
            found[unmet] = [new[k] for k in keys]
            place.update({k: at for k, at in new.items() if len(k) <= CACHE_CHARS})
        return found

    def _whole(self, text: str) -> list[int]:
        """Ids of one text, encoded in long pieces."""
        pieces, start = [], 0
        while len(text) - start > WHOLE_CHARS and (cut := self.safe_cut.search(text, start + WHOLE_CHARS)):
            pieces.append(text[start : cut.start()])
            start = cut.start() + (not self.lead)
        pieces.append(text[start:])
        return [i for ids in self.encode_many(pieces) for i in ids]

    def encode(self, texts: pa.Array, want_ids: bool = True) -> tuple[np.ndarray, np.ndarray | None]:
        """Number of ids of each text, and all ids in order. Null texts are empty."""
        if len(self.starts) > CACHE_SEGMENTS or len(self.flat) > 16 * CACHE_SEGMENTS:
            self._forget()
        texts = pc.fill_null(texts, "")
        irregular = pc.match_substring_regex(texts, self.irregular).to_numpy(zero_copy_only=False)
        empty = pc.binary_length(texts).to_numpy(zero_copy_only=False) == 0
        regular = ~irregular & ~empty
        plain = texts.filter(pa.array(regular))
        if self.stops_apart:
            plain = pc.replace_substring_regex(plain, f"([A-Za-z])({_STOPS})", rf"\1 {_MARK}\2")
        lists = pc.split_pattern(plain, " ")
        offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py() if len(lists) else np.zeros(1, np.int64)
        coded = lists.flatten().dictionary_encode()
        places = np.zeros(0, np.int64)
        if len(coded):
            keys = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
            codes = coded.indices.to_numpy()
            firsts = [keys[c] for c in codes[offsets[:-1]]]
            both = self._places([k[1:] if k[:1] == _MARK else self.lead + k for k in keys] + firsts)
            places = both[: len(keys)][codes]
            places[offsets[:-1]] = both[len(keys) :]
        odd = np.flatnonzero(irregular)
        whole_places = self._add(_coded([self._whole(texts[int(i)].as_py()) for i in odd]))

        of_text = np.zeros(len(texts), np.int64)
        of_text[regular] = np.diff(offsets)
        of_text[irregular] = 1
        if len(odd):
            ends = np.cumsum(of_text)
            every = np.empty(ends[-1], np.int64)
            mark = np.zeros(ends[-1], bool)
            at = ends[odd] - 1
            mark[at] = True
            every[at] = whole_places
            every[~mark] = places
            places = every
        counts = _view(self.lengths, np.int64)[places]
        upto = np.concatenate([[0], np.cumsum(counts)])
        ends = np.concatenate([[0], np.cumsum(of_text)])
        n_tokens = upto[ends[1:]] - upto[ends[:-1]]
        ids = None
        if want_ids:
            source = np.repeat(_view(self.starts, np.int64)[places] - upto[:-1], counts) + np.arange(upto[-1])
            ids = _view(self.flat, np.uint32)[source]
        return n_tokens, ids


@lru_cache(maxsize=4)
def encoder(name: str) -> SegmentEncoder:
    """The encoder for a tokenizer file, one per Python worker."""
    one_thread()
    path = tokenizer_path(name)
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        crossing = [i for i in range(model.get_piece_size()) if _SPACE_PIECE in model.id_to_piece(i).lstrip(_SPACE_PIECE)]
        if crossing or model.encode("a a", out_type=str)[1:] != model.encode("a", out_type=str):
            raise ValueError(f"{name} has tokens that reach across spaces; its texts cannot be cut there")
        irregular, safe_cut = rf"{IRREGULAR}|{_SPACE_PIECE}", re.compile(rf"(?<=[^\s{_SPACE_PIECE}]) (?=[^\s{_SPACE_PIECE}])")
        return SegmentEncoder(lambda texts: model.encode(texts, num_threads=1), "", False, irregular, safe_cut)
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)

    def encode_many(texts: list[str]) -> list[list[int]]:
        # The library's results are large objects, so only some are alive at a time.
        parts = (texts[i : i + BATCH_TEXTS] for i in range(0, len(texts), BATCH_TEXTS))
        return [e.ids for part in parts for e in model.encode_batch_fast(part, add_special_tokens=False)]

    # Where white space is dropped, a leading space changes nothing and segments need none.
    lead = " " if encode_many([" "])[0] else ""
    opens = _opens(model) if lead else None
    encode_segments = _joined(encode_many, lead) if opens is None else _side_by_side(encode_many, opens)
    return SegmentEncoder(encode_many, lead, stops_apart=True, encode_segments=encode_segments)


def _opens(model) -> np.ndarray | None:
    """Per id, if its token holds a space, for tokenizers of bytes that cut before a space and change nothing else."""
    from tokenizers.pre_tokenizers import ByteLevel

    cut = model.pre_tokenizer
    if model.normalizer is not None or not isinstance(cut, ByteLevel) or cut.add_prefix_space or not cut.use_regex:
        return None
    if not all(t.content.startswith("<") for t in model.get_added_tokens_decoder().values()):
        return None
    vocabulary = model.get_vocab(with_added_tokens=True)
    opens = np.zeros(max(vocabulary.values()) + 1, bool)
    opens[[i for token, i in vocabulary.items() if _SPACE_BYTE in token]] = True
    return opens


def _side_by_side(encode_many, opens: np.ndarray):
    """Encode segments several to a text, told apart by their only token with a space, which is their first."""

    def encode_segments(segments: list[str]) -> Coded:
        plain = pc.match_substring_regex(pa.array(segments, pa.string()), _ONE_WORD).to_numpy(zero_copy_only=False)
        words = [segments[i] for i in np.flatnonzero(plain).tolist()]
        texts = ["".join(words[i : i + JOINED_SEGMENTS]) for i in range(0, len(words), JOINED_SEGMENTS)]
        ids = _coded(encode_many(texts))[2]
        begins = np.flatnonzero(opens[ids])
        if len(begins) != len(words):
            raise ValueError("Segments that begin with a space do not begin with a token that holds it")
        other_starts, other_sizes, other_ids = _coded(encode_many([segments[i] for i in np.flatnonzero(~plain).tolist()]))
        starts, sizes = np.empty(len(segments), np.int64), np.empty(len(segments), np.int64)
        starts[plain], sizes[plain] = begins, np.diff(begins, append=len(ids))
        starts[~plain], sizes[~plain] = len(ids) + other_starts, other_sizes
        return starts, sizes, np.concatenate([ids, other_ids])

    return encode_segments


def _joined(encode_many, lead: str):
    """Encode segments several to a text, with a mark between them that is a token of its own and occurs in none."""
    between = f" {_MARK}{lead or ' '}"
    *front, mark = encode_many([f" {_MARK}"])[0]

    def encode_segments(segments: list[str]) -> Coded:
        out: list[list[int] | None] = [None] * len(segments)
        # White space or a special token at an end of a segment might take in the space of the mark, and a segment
        # without the space in front might join with the mark.
        plain = [i for i, s in enumerate(segments) if s.startswith(lead) and len(s.split()) == 1 and "<|" not in s]
        joined = [plain[i : i + JOINED_SEGMENTS] for i in range(0, len(plain), JOINED_SEGMENTS)]
        texts = [lead + between.join([segments[i][len(lead) :] for i in group]) for group in joined]
        for group, ids in zip(joined, encode_many(texts)):
            at = 0
            for i in group[:-1]:
                end = ids.index(mark, at)
                out[i] = ids[at : end - len(front)]
                at = end + 1
            out[group[-1]] = ids[at:]
        rest = [i for i, ids in enumerate(out) if ids is None]
        for i, ids in zip(rest, encode_many([segments[i] for i in rest])):
            out[i] = ids
        return _coded(out)

    return encode_segments
