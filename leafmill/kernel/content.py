"""Content streams: operations, and the interpreter that turns them into positioned text runs."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

from .fonts import Font, decode_text, load_font
from .structure import MAX_FORM_DEPTH, MAX_FORMS_DRAWN, Structure
from .values import END, Keyword, Name, PdfString, Reader, Stream, SyntaxTrouble

Matrix = tuple[float, float, float, float, float, float]
IDENTITY: Matrix = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)
#: A glyph is taken to be this wide, in parts of the font size.
GLYPH_WIDTH = 0.55


def multiply(a: Matrix, b: Matrix) -> Matrix:
    """The matrix that applies b, then a."""
    return (
        a[0] * b[0] + a[2] * b[1], a[1] * b[0] + a[3] * b[1], a[0] * b[2] + a[2] * b[3], a[1] * b[2] + a[3] * b[3],
        a[0] * b[4] + a[2] * b[5] + a[4], a[1] * b[4] + a[3] * b[5] + a[5],
    )


def apply(m: Matrix, x: float, y: float) -> tuple[float, float]:
    return m[0] * x + m[2] * y + m[4], m[1] * x + m[3] * y + m[5]


@dataclass(frozen=True)
class Run:
    """Text shown at a point of the page, with the registers that layout looks at."""

    text: str
    x: float
    y: float
    width: float
    font_size: float
    char_spacing: float
    word_spacing: float


def operations(data: bytes) -> Iterator[tuple[str, list]]:
    """(operator, operands) in order. An inline image comes as one BI operation with its dictionary and data."""
    reader, held = Reader(data, refs=False), []
    while True:
        try:
            v = reader.value()
        except SyntaxTrouble:
            held = []
            continue
        if v is END:
            return
        if not isinstance(v, Keyword):
            held.append(v)
            continue
        if v in (b"]", b">>", b"{", b"}", b")", b">"):
            continue
        if v == b"BI":
            yield "BI", _inline(reader)
        else:
            yield v.decode("latin-1"), held
        held = []


def _inline(reader: Reader) -> list:
    d: dict = {}
    while True:
        key = reader.value()
        if key is END or isinstance(key, Keyword):
            break
        value = reader.value()
        if isinstance(key, Name) and not isinstance(value, Keyword):
            d[key] = value
    begin = reader.pos + 1
    at = reader.data.find(b"EI", begin)
    white = b"\x00\t\n\f\r "
    while at >= 0 and not (reader.data[at - 1 : at] in [white[i : i + 1] for i in range(6)] and (at + 2 == len(reader.data) or reader.data[at + 2] in white)):
        at = reader.data.find(b"EI", at + 2)
    end = at if at >= 0 else len(reader.data)
    reader.pos = min(len(reader.data), end + 2)
    return [d, reader.data[begin : max(begin, end - 1)]]


@dataclass
class Registers:
    """Text and graphics state that q and Q keep."""

    ctm: Matrix = IDENTITY
    char_spacing: float = 0.0
    word_spacing: float = 0.0
    scale: float = 100.0
    leading: float = 0.0
    font: Font | None = None
    size: float = 0.0
    mode: int = 0
    rise: float = 0.0


class Interpreter:
    """Runs the operations of a content stream over resources. compat: matrices in the order of older releases."""

    def __init__(self, structure: Structure, resources: dict, fonts: dict | None = None, depth: int = 0, compat: bool = False):
        self.structure, self.resources, self.depth, self.compat = structure, resources or {}, depth, compat
        self.fonts = {} if fonts is None else fonts
        self.now, self.stack = Registers(), []
        self.matrix = self.line = IDENTITY
        self.marked: list[bool] = []
        self.runs: list[Run] = []

    def run(self, data: bytes) -> list[Run]:
        for operator, operands in operations(data):
            step = _STEPS.get(operator)
            if step:
                try:
                    step(self, operands)
                except (TypeError, ValueError, IndexError, OverflowError):
                    continue  # operands of the wrong number or kind
        return self.runs

    # -- helpers

    def _named(self, kind: str, name) -> object:
        held = self.structure.resolve(self.resources.get(kind))
        return held.get(name) if isinstance(held, dict) and isinstance(name, Name) else None

    def _silent(self) -> bool:
        return bool(self.marked) and self.marked[-1]

    def _width(self, text: str) -> float:
        return len(text) * self.now.size * GLYPH_WIDTH * self.now.scale / 100

    def _advance(self, by: float) -> None:
        self.matrix = multiply(self.matrix, (1.0, 0.0, 0.0, 1.0, by, 0.0))

    def _emit(self, text: str, at: Matrix, advance: float) -> None:
        x, y = at[4], at[5]
        ex, ey = apply(at, advance, 0.0)
        self.runs.append(Run(text, x, y, math.hypot(ex - x, ey - y), self.now.size, self.now.char_spacing, self.now.word_spacing))

    def _text(self, value) -> str:
        raw = value if isinstance(value, bytes) else b""
        return self.now.font.decode(raw) if self.now.font else raw.decode("latin-1")

    # -- operators

    def begin_text(self, _) -> None:
        self.matrix = self.line = IDENTITY

    def set_matrix(self, o) -> None:
        if len(o) == 6:
            self.matrix = self.line = tuple(float(v) for v in o)

    def move(self, o) -> None:
        shift = (1.0, 0.0, 0.0, 1.0, float(o[0]), float(o[1]))
        self.line = multiply(shift, self.line) if self.compat else multiply(self.line, shift)
        self.matrix = self.line

    def move_leading(self, o) -> None:
        self.now.leading = -float(o[1])
        self.move(o)

    def next_line(self, _=()) -> None:
        self.move((0.0, -self.now.leading))

    def show(self, o) -> None:
        if len(o) != 1:
            return
        text = self._text(o[0])
        advance = self._width(text) + max(0, len(text) - 1) * self.now.char_spacing
        if not self._silent():
            self._emit(text, multiply(self.now.ctm, self.matrix), advance)
        self._advance(advance)

    def line_show(self, o) -> None:
        self.next_line()
        self.show(o)

    def spaced_line_show(self, o) -> None:
        if len(o) == 3:
            self.now.word_spacing, self.now.char_spacing = float(o[0]), float(o[1])
            self.line_show(o[2:])

    def show_array(self, o) -> None:
        if len(o) != 1 or not isinstance(o[0], list):
            return
        start, total, parts, after_text = multiply(self.now.ctm, self.matrix), 0.0, [], False
        gap = max(self.now.word_spacing * 0.7, self.now.size * 0.4)
        for item in o[0]:
            if isinstance(item, bytes):
                text = self._text(item)
                parts.append(text)
                step, after_text = self._width(text), bool(text)
            elif isinstance(item, (int, float)):
                step = -item / 1000 * self.now.size * self.now.scale / 100
                if step > gap and after_text and any(parts):
                    parts.append(" ")
                after_text = False
            else:
                continue
            total += step
            self._advance(step)
        text = "".join(parts)
        if text and not self._silent():
            self._emit(text, start, total)

    def begin_marked(self, o) -> None:
        silent, text = self._silent(), None
        if len(o) >= 2:
            properties = self.structure.resolve(self._named("Properties", o[1])) if isinstance(o[1], Name) else o[1]
            actual = self.structure.resolve(properties.get("ActualText")) if isinstance(properties, dict) else None
            if isinstance(actual, PdfString):
                text = decode_text(actual)
        if text is not None and not silent:
            at = multiply(self.now.ctm, self.matrix)
            self.runs.append(Run(text, at[4], at[5], self._width(text), self.now.size, self.now.char_spacing, self.now.word_spacing))
            silent = True
        self.marked.append(silent)

    def end_marked(self, _) -> None:
        if self.marked:
            self.marked.pop()

    def font(self, o) -> None:
        name, self.now.size = o[0], float(o[1])
        if name not in self.fonts:
            value = self._named("Font", name)
            self.fonts[name] = load_font(self.structure, value) if value is not None else None
        if self.fonts[name] is not None:
            self.now.font = self.fonts[name]

    def save(self, _) -> None:
        self.stack.append((replace(self.now), self.matrix, self.line))

    def restore(self, _) -> None:
        if self.stack:
            self.now, self.matrix, self.line = self.stack.pop()

    def concat(self, o) -> None:
        if len(o) == 6:
            m = tuple(float(v) for v in o)
            self.now.ctm = multiply(m, self.now.ctm) if self.compat else multiply(self.now.ctm, m)

    def xobject(self, o) -> None:
        form = self.structure.resolve(self._named("XObject", o[0])) if len(o) == 1 else None
        if not isinstance(form, Stream) or self.structure.resolve(form.dictionary.get("Subtype")) != "Form":
            return
        if self.depth >= MAX_FORM_DEPTH or self.structure.forms_drawn >= MAX_FORMS_DRAWN:
            self.structure.note(f"cut at {MAX_FORM_DEPTH} levels or {MAX_FORMS_DRAWN} drawings of forms")
            return
        self.structure.forms_drawn += 1
        resources = self.structure.resolve(form.dictionary.get("Resources"))
        own = isinstance(resources, dict)
        inner = Interpreter(self.structure, resources if own else self.resources, None if own else self.fonts, self.depth + 1, self.compat)
        runs = inner.run(self.structure.decoded(form))
        if self._silent():
            return
        m = self.structure.resolve(form.dictionary.get("Matrix"))
        m = tuple(float(v) if isinstance(v := self.structure.resolve(x), (int, float)) else 0.0 for x in m) if isinstance(m, list) and len(m) == 6 else IDENTITY
        ctm = multiply(m, self.now.ctm) if self.compat else multiply(self.now.ctm, m)
        sx, sy = math.hypot(ctm[0], ctm[1]), math.hypot(ctm[2], ctm[3])
        for r in runs:
            x, y = apply(ctm, r.x, r.y)
            self.runs.append(Run(r.text, x, y, r.width * sx, r.font_size * sy, r.char_spacing * sx, r.word_spacing * sx))


def _register(name: str):
    def step(self: Interpreter, o) -> None:
        setattr(self.now, name, float(o[0]))

    return step


_STEPS = {
    "BT": Interpreter.begin_text, "ET": lambda self, o: None, "BDC": Interpreter.begin_marked, "BMC": Interpreter.begin_marked, "EMC": Interpreter.end_marked,
    "Tm": Interpreter.set_matrix, "Td": Interpreter.move, "TD": Interpreter.move_leading, "T*": Interpreter.next_line, "Tj": Interpreter.show, "'": Interpreter.line_show,
    '"': Interpreter.spaced_line_show, "TJ": Interpreter.show_array, "Tc": _register("char_spacing"), "Tw": _register("word_spacing"), "Tz": _register("scale"),
    "TL": _register("leading"), "Tf": Interpreter.font, "Tr": _register("mode"), "Ts": _register("rise"), "q": Interpreter.save, "Q": Interpreter.restore,
    "cm": Interpreter.concat, "Do": Interpreter.xobject,
}
OPERATORS = frozenset(_STEPS)
