"""Reading of piece vocabularies: the public model file gives pieces, scores and flags; nothing is trained."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import public_tokenizers
import sentencepiece

#: Stands for a space inside pieces.
GAP = "▁"
RUNS = re.compile(f"{GAP}+[^{GAP}]*|[^{GAP}]+")


def default_model() -> str:
    return public_tokenizers.path("piece_bpe_32k.model")


@dataclass(frozen=True)
class Vocabulary:
    """ids and scores of the pieces that may match text; texts, by id, of all pieces; ids of the byte pieces by byte."""

    ids: dict[str, int]
    scores: dict[str, float]
    texts: list[str]
    bytes: list[int]
    control: frozenset[int]
    unknown: int

    @property
    def gap_starts(self) -> bool:
        """True if no piece has a gap after another character: then text can be cut before each run of gaps."""
        return all(GAP not in p.lstrip(GAP) for p in self.ids)

    def automaton(self, value) -> ahocorasick.Automaton:
        found = ahocorasick.Automaton()
        for piece in self.ids:
            found.add_word(piece, value(piece))
        found.make_automaton()
        return found


@lru_cache(maxsize=4)
def load(path: str) -> Vocabulary:
    """The vocabulary of a sentencepiece model file that has identity normalisation and byte fallback."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    every = range(model.get_piece_size())
    texts = [model.id_to_piece(i) for i in every]
    by_byte = {int(texts[i][3:5], 16): i for i in every if model.is_byte(i)}
    control = frozenset(i for i in every if model.is_control(i))
    normal = [i for i in every if not (model.is_byte(i) or model.is_unknown(i) or i in control)]
    if len(by_byte) != 256 or any(model.is_unused(i) for i in every):
        raise ValueError("only vocabularies with byte fallback and without unused pieces are supported")
    return Vocabulary({texts[i]: i for i in normal}, {texts[i]: model.get_score(i) for i in normal}, texts, [by_byte[b] for b in range(256)], control, model.unk_id())


def escaped(text: str) -> str:
    """The text as the library sees it before segmentation: a gap first, gaps for spaces. Empty stays empty."""
    return GAP + text.replace(" ", GAP) if text else ""
