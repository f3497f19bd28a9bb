"""Text set again in a box: lines as long as fit, broken where scripts allow it, in steps of smaller sizes until all fits.

How a paragraph breaks depends on what stands before, so each text is set in its own row, by widths of its font; texts are
dealt out as they come, and nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from unicodedata import category

import pyarrow as pa
from pyspark.sql import DataFrame

from quire.operators.groups import slices
from quire.operators.sequential import LEADING

# Fixed values, in points: what still counts as fitting, the step of sizes, the least size; and how many characters of a
# broken word stay on either side.
FITS, STEP, LEAST, PART = 0.25, 0.5, 1.0, 2
# Characters that are written without spaces (Han, kana, Bopomofo, their marks and wide forms), and those that
# never begin or never end a line.
IDEOGRAPHIC = re.compile("[⺀-⿟々-〇〡-〩㐀-䶿一-鿿豈-﫿\U00020000-\U0003134f぀-ヿㇰ-ㇿㄅ-ㄯㆠ-ㆿ　-〿！-／：-＠［-｠ｦ-ﾟ￠-￦]")
NO_START = re.compile("[、。，．・：；！？）］｝〕〉》」』】〙〗〟’”‥…ー々ゝゞヽヾぁぃぅぇぉっゃゅょゎゕゖァィゥェォッャュョヮヵヶ)\\]}!?,.:;ๆ]")
NO_END = re.compile("[（［｛〔〈《「『【〘〖〝‘“(\\[{]\\Z")


def break_units(word: str) -> list[str]:
    """The pieces of a word between which a line may end: each ideographic character with the marks on it, and what stands
    between them; a piece that can't begin a line, or follows one that can't end it, stays with the one before. Scripts that
    need a dictionary (Thai, Lao, Khmer, Burmese) stay whole."""
    if not IDEOGRAPHIC.search(word):
        return [word]
    pieces: list[str] = []
    wide = None
    for c in word:
        if pieces and (category(c)[0] == "M" or c == "‍"):
            pieces[-1] += c
            continue
        own = IDEOGRAPHIC.match(c) is not None
        if pieces and not own and wide is False:
            pieces[-1] += c
        else:
            pieces.append(c)
        wide = own
    units: list[str] = []
    for piece in pieces:
        if units and (NO_START.match(piece) or NO_END.search(units[-1])):
            units[-1] += piece
        else:
            units.append(piece)
    return units


@dataclass
class Face:
    """Widths of a font's characters in parts of an em; `other` is that of those not listed, ascent and descent are in ems."""

    widths: dict[str, float]
    other: float = 0.5
    ascent: float = 0.8
    descent: float = -0.2

    def width(self, text: str, size: float) -> float:
        return sum(self.widths.get(c, self.other) for c in text) * size


def _hyphenated(word: str, room: float, size: float, face: Face) -> tuple[str, str] | None:
    head = ""
    for c in word[: len(word) - PART]:
        if face.width(head + c + "-", size) > room:
            break
        head += c
    return (head + "-", word[len(head) :]) if len(head) >= PART else None


def broken(paragraph: list[list[str]], width: float, indent: float, size: float, face: Face, hyphenate: bool) -> list[tuple[str, float, float]]:
    """(text, width, indent) of the lines of a paragraph, given as words of units. A word that doesn't fit a line of its own
    is broken with a hyphen where that is wanted and it has no places of its own to break; else it stands out."""
    lines: list[tuple[str, float, float]] = []
    text, used, lead, space = "", 0.0, indent, face.width(" ", size)
    for units in paragraph:
        breakable = hyphenate and len(units) == 1 and not IDEOGRAPHIC.search(units[0])
        for k, rest in enumerate(units):
            while True:
                room, own = width - lead, face.width(rest, size)
                joint = "" if not text or k else " "
                long = used + (space if joint else 0.0) + own
                cut = None
                if long <= room + FITS:
                    text, used = text + joint + rest, long
                    break
                if not text:
                    cut = _hyphenated(rest, room, size, face) if breakable else None
                    if not cut:
                        text, used = rest, own
                        break
                    text, rest = cut
                    used = face.width(text, size)
                lines.append((text, used, lead))
                text, used, lead = "", 0.0, 0.0
    return [*lines, (text, used, lead)]


def set_text(text: str, width: float, height: float | None, size: float, face: Face, leading: float | None = None, least: float | None = None, indent: float = 0.0, between: float = 0.0, hyphenate: bool = False) -> tuple[float, bool, list[tuple]]:
    """(size, overflow, lines) of a text in a box, lines as (text, paragraph, top, width, indent). Without a height the box
    grows. Sizes go down by STEP to `least` while a line stands out or the lines are too high."""
    step = leading if leading and leading > 0 else size * LEADING
    smallest = min(max(size if least is None else least, LEAST), size)
    paragraphs = [[break_units(w) for w in p.split(" ")] for raw in re.split(r"\r\n|\r|\n", text) if (p := re.sub(r"[ \t\f\r]+", " ", raw).strip())]
    tried = size
    while True:
        now = max(tried, smallest)
        lines, top, out = [], 0.0, False
        for k, p in enumerate(paragraphs):
            top += between if k else 0.0
            for t, w, lead in broken(p, width, indent, now, face, hyphenate):
                out |= w > width - lead + FITS
                lines.append((t, k, top, w, lead))
                top += step
        foot = lines[-1][2] + (face.ascent - face.descent) * now if lines else 0.0
        over = out or (height is not None and foot > height + FITS)
        if not over or now <= smallest:
            return now, over, lines
        tried -= STEP


def reflowed_blocks(blocks: DataFrame, face: Face, key: str = "block", **settings) -> DataFrame:
    """(key, size, overflow, lines) of blocks (key, text, width, height, size); a null height leaves the box free to grow, a
    null text has no lines. settings are those of set_text."""
    line = "struct<text:string,paragraph:int,top:double,width:double,indent:double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("text", pa.string()), ("paragraph", pa.int32()), ("top", pa.float64()), ("width", pa.float64()), ("indent", pa.float64())]))
        for batch in slices(batches, "text"):
            made = [set_text(r["text"] or "", r["width"], r["height"], r["size"], face, **settings) for r in batch.to_pylist()]
            lines = [[dict(zip(("text", "paragraph", "top", "width", "indent"), x, strict=True)) for x in m[2]] for m in made]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([m[0] for m in made], pa.float64()), pa.array([m[1] for m in made], pa.bool_()), pa.array(lines, kind)], names=[key, "size", "overflow", "lines"])

    kept = blocks.select(key, "text", "width", "height", "size")
    return kept.mapInArrow(run, f"{key} {dict(blocks.dtypes)[key]}, size double, overflow boolean, lines array<{line}>")
