"""Messages in another language by a dictionary of whole ones and of templates with holes. Helper of operators.translation."""

from __future__ import annotations

import re
from dataclasses import dataclass

#: How deep what stands in holes is translated; marks that part pieces, in the order they are tried.
DEPTH, MARKS = 3, (" · ", " — ", " / ", "; ")
_HOLE = re.compile(r"\{(#?)([0-9])\}")
#: A sentence ends before a capital letter or an opening quotation.
_SENTENCE = re.compile(r"(?<=[.!?:])\s+(?=[A-Z“\"(«¿])")
_LANGUAGE = re.compile(r"[A-Za-z]\.?[A-Za-z]")


def plain(text: str) -> str:
    """White space as single spaces, none at the ends."""
    return " ".join(text.split())


@dataclass(frozen=True)
class Template:
    shape: re.Pattern
    probe: str  # its longest literal piece
    weight: int  # characters of all literal pieces
    to: str
    quoted: frozenset  # holes in quotation marks: names, never translated

    @classmethod
    def of(cls, source: str, to: str) -> "Template":
        """{0} takes any text, {#0} a number; a hole named twice must be filled alike."""
        shape, literals, at, named = [], [], 0, set()
        text = plain(source)
        for m in [*_HOLE.finditer(text), None]:
            literals.append(text[at : m.start() if m else len(text)])
            shape.append(re.escape(literals[-1]))
            if m is None:
                break
            name = f"{'n' if m[1] else 's'}{m[2]}"
            fill = r"-?[0-9][0-9.,]*" if m[1] else r".+?"
            shape.append(f"(?P={name})" if name in named else f"(?P<{name}>{fill})")
            named.add(name)
            at = m.end()
        quoted = frozenset(re.findall(r"“\{#?([0-9])\}”", source))
        return cls(re.compile("".join(shape)), max(literals, key=len), sum(map(len, literals)), to, quoted)

    def key(self, source: str) -> str:
        """A word that stands whole in every text of this shape, the longest; empty if there is none."""
        return max((w for w in plain(source).split() if not _HOLE.search(w)), key=len, default="")


class Phrases:
    def __init__(self, exact: list[tuple[str, str]], templates: list[tuple[str, str]], ignored: tuple[str, ...] = ()):
        self.exact = {plain(a): b for a, b in exact}
        self.ignored = [re.compile(p) for p in ignored]
        self.by_word: dict[str, list[tuple[int, int, Template]]] = {}
        for i, (source, to) in enumerate(templates):
            t = Template.of(source, to)
            self.by_word.setdefault(t.key(source), []).append((-t.weight, i, t))

    def leaves(self, text: str) -> bool:
        """Whether a text is no language: numbers, names of files, initials."""
        return not _LANGUAGE.search(text) or any(p.search(text) for p in self.ignored)

    def candidates(self, text: str) -> list[Template]:
        """Templates whose word and longest piece the text has, those with most literal characters first, then in their order."""
        found = [t for w in {"", *text.split()} for t in self.by_word.get(w, ())]
        return [t for _, _, t in sorted(found, key=lambda x: x[:2]) if t.probe in text]

    def filled(self, t: Template, held: dict, depth: int) -> str:
        def fill(m: re.Match) -> str:
            number, value = held.get(f"n{m[2]}"), held.get(f"s{m[2]}")
            if value is None or m[1] and number is not None:
                return number or ""
            if m[2] in t.quoted or depth >= DEPTH or self.leaves(value):
                return value
            inner = self.lookup(value, depth + 1)
            return value if inner is None else inner

        return _HOLE.sub(fill, t.to)

    def pieces(self, parts: list[str], mark: str, depth: int, keep: bool) -> str | None:
        """The pieces translated each, null if one is not; keep: pieces that are no language stay."""
        out = []
        for p in parts:
            one = p if keep and self.leaves(p) else self.lookup(p, depth + 1)
            if one is None:
                return None
            out.append(one)
        return mark.join(out)

    def lookup(self, text: str, depth: int = 0) -> str | None:
        """A text by the dictionary: as a whole, by the first template that fits, by its pieces, by its sentences; else None."""
        if text in self.exact:
            return self.exact[text]
        for t in self.candidates(text):
            if m := t.shape.fullmatch(text):
                return self.filled(t, m.groupdict(), depth)
        for mark in MARKS:
            if mark in text and (out := self.pieces(text.split(mark), mark, depth, True)) is not None:
                return out
        sentences = _SENTENCE.split(text)
        return self.pieces(sentences, " ", depth, False) if len(sentences) > 1 else None

    def translated(self, text: str) -> str | None:
        """A text with its outer white space kept; None where the dictionary has nothing."""
        body = text.strip()
        out = None if not body else self.lookup(plain(body))
        return None if out is None else text[: len(text) - len(text.lstrip())] + out + text[len(text.rstrip()) :]
