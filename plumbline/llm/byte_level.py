"""Ids of whole texts by a byte-level BPE vocabulary of the tokenizers library, each different word encoded once per worker.

The library's pieces never reach over a single space between two other characters (the space goes with what follows it) nor over a single line feed (a piece of its
own). A text is cut there; words are looked up, and only new ones go to the library. White space in other numbers is cut as the library's pattern cuts it: before a
word its last character stands alone or, if it is a space, with the word. A vocabulary with another normalizer or pre-tokenizer, or with added tokens that hold white space, is given whole texts.
"""

from __future__ import annotations

import json
import os
import re

from plumbline.llm.bpe import halve, visible_bytes

#: Words that a worker remembers, of each kind.
TABLE_SIZE = 1_000_000
# fixed values: Unicode's White_Space
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
_CHUNK = re.compile(f"([{SPACE}]*)([^{SPACE}]*)")
_VISIBLE = dict(visible_bytes())
_SPACE = _VISIBLE[ord(" ")]
_MARKS = (".", ",")


class Encoder:
    """ids(texts): the little-endian ids of each text, 4 bytes each."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        with open(path, encoding="utf-8") as f:
            kind = json.load(f)
        self.special = [x["content"] for x in kind["added_tokens"]]
        before = kind["pre_tokenizer"] or {}
        plain = not any(x["lstrip"] or x["rstrip"] or x["single_word"] or any(c in SPACE for c in x["content"]) for x in kind["added_tokens"])
        self.cuts = plain and kind["normalizer"] is None and before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space")
        self.code = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size(with_added_tokens=True))]
        self.spaced: dict[str, bytes] = {}  # words with the space before them
        self.bare: dict[str, bytes] = {}

    def _library(self, texts: list[str]) -> list[bytes]:
        fast = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        code = self.code
        return [b"".join([code[i] for i in e.ids]) for e in fast(texts, add_special_tokens=False)]

    def _word(self, lead: str, word: str) -> bytes:
        """A space or none and letters: one piece, which can go straight to the model."""
        code = self.code
        seen = word if word.isascii() else word.encode().decode("latin-1").translate(_VISIBLE)
        return b"".join([code[t.id] for t in self.model.tokenize(_SPACE + seen if lead else seen)])

    def _learn(self, table: dict[str, bytes], lead: str, words: set[str]) -> None:
        """Words that begin and end with anything but white space."""
        rest = []
        for w in words:
            if w.isalpha():
                table[w] = self._word(lead, w)
            elif w[-1] in _MARKS and w[:-1].isalpha():
                stem = w[:-1]
                if stem not in table:
                    table[stem] = self._word(lead, stem)
                table[w] = table[stem] + self.code[self.tokenizer.token_to_id(w[-1])]
            else:
                rest.append(w)
        table.update(zip(rest, self._library([lead + w for w in rest]), strict=True))

    def _look_up(self, lead: str, words: set[str]) -> None:
        table = self.spaced if lead else self.bare
        self._learn(table, lead, {w for w in words if w not in table and w and w[0] not in SPACE and w[-1] not in SPACE})

    def _pieces(self, text: str) -> list[tuple[str, str]]:
        """(lead, word) of a text whose white space comes in other numbers than one; what is left of white space has the lead None."""
        out: list[tuple[str | None, str]] = []
        for space, word in _CHUNK.findall(text):
            if not word:
                out.append((None, space))
            elif space.endswith(" "):
                out += [(None, space[:-1]), (" ", word)]
            else:
                out += [(None, space[:-1]), (None, space[-1:]), ("", word)]
        return [x for x in out if x[1]]

    def ids(self, texts: list[str | None]) -> list[bytes]:
        if not self.cuts:
            return self._library([x or "" for x in texts])
        for table in (self.spaced, self.bare):
            if len(table) > TABLE_SIZE:  # the words met first are the frequent ones
                halve(table)
        spaced, bare, feed = self.spaced, self.bare, self._library(["\n"])[0]
        lines = [line.split(" ") for x in texts for line in (x or "").split("\n")]
        firsts = [words.pop(0) for words in lines]
        found = [list(map(spaced.get, words)) for words in lines]
        gaps = [(words, parts) for words, parts in zip(lines, found, strict=True) if None in parts]
        self._look_up("", set(firsts).difference(bare))
        self._look_up(" ", {w for words, parts in gaps for w, x in zip(words, parts, strict=True) if x is None})
        for words, parts in gaps:
            parts[:] = [spaced.get(w) if x is None else x for w, x in zip(words, parts, strict=True)]
        done = iter([None if (x := bare.get(first)) is None or None in parts else x + b"".join(parts) for first, parts in zip(firsts, found, strict=True)])
        out: list[bytes | None] = []
        for x in texts:
            own = [next(done) for _ in range((x or "").count("\n") + 1)]
            out.append(None if None in own else feed.join(own))
        odd = [k for k, x in enumerate(out) if x is None]
        whole = [k for k in odd if any(s in (texts[k] or "") for s in self.special)]
        for k, x in zip(whole, self._library([texts[k] for k in whole]), strict=True):
            out[k] = x
        for k in odd:
            if out[k] is None:
                pieces = self._pieces(texts[k] or "")
                blank = dict.fromkeys([x for lead, x in pieces if lead is None])
                blank = dict(zip(blank, self._library(list(blank)), strict=True))
                for lead in ("", " "):
                    self._look_up(lead, {w for own, w in pieces if own == lead})
                out[k] = b"".join([blank[w] if lead is None else (self.spaced if lead else self.bare)[w] for lead, w in pieces])
        return out
