"""OCR of a page image around two injected models: detect boxes, read each by itself, filter, order, gate.

``detect``: tensor (1, 3, H, W) to a probability map of H * W (or a map and a threshold map, 2 * H * W).
``recognize``: tensor (1, 3, 48, W) to class probabilities (steps, classes); class 0 is blank, the last a space.
Images are arrays (height, width, 3), red first.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np

from .ocr import BOX_CONFIDENCE, DET_SIDE, DOC_CONFIDENCE, LINE_GAP, MIN_SIDE, REC_HEIGHT, REC_WIDTH, DBParams, text_boxes

# What the detector's colours are normalised by.
MEAN, STD = np.array([0.485, 0.456, 0.406], np.float32), np.array([0.229, 0.224, 0.225], np.float32)


def rounded(x: float) -> int:
    return int(np.floor(x + 0.5))


def resized(image: np.ndarray, width: int, height: int) -> np.ndarray:
    """Bilinear, sampled at pixel centres."""
    h, w = image.shape[:2]
    if (h, w) == (height, width):
        return image.astype(np.float32)

    def along(n: int, m: int):
        at = np.clip((np.arange(m) + 0.5) * n / m - 0.5, 0, n - 1)
        low = np.floor(at).astype(int)
        return low, np.minimum(low + 1, n - 1), (at - low).astype(np.float32)

    top, bottom, dy = along(h, height)
    left, right, dx = along(w, width)
    dy, dx, image = dy[:, None, None], dx[None, :, None], image.astype(np.float32)
    rows = image[top] * (1 - dy) + image[bottom] * dy
    return rows[:, left] * (1 - dx) + rows[:, right] * dx


def det_tensor(image: np.ndarray, side: int = DET_SIDE) -> tuple[np.ndarray, float, float]:
    """(tensor, width ratio, height ratio) of the detector's input: fitted into a square of ``side``, then to multiples of 32."""
    h, w = image.shape[:2]
    ratio = min(side / w, side / h)
    width, height = (max(32, rounded(rounded(x * ratio) / 32) * 32) for x in (w, h))
    pixels = (resized(image, width, height) / 255 - MEAN) / STD
    return pixels.transpose(2, 0, 1)[None].astype(np.float32), w / width, h / height


def rec_tensor(crop: np.ndarray, target: int | None = None) -> np.ndarray:
    """The recogniser's input: 48 high, as wide as the shape asks (2048 at most), blue first, white to the right up to ``target``."""
    h, w = crop.shape[:2]
    width = max(1, min(REC_WIDTH, rounded(REC_HEIGHT * w / max(1, h))))
    out = np.ones((3, REC_HEIGHT, target or width), np.float32)
    out[:, :, :width] = ((resized(crop, width, REC_HEIGHT)[:, :, ::-1] / 255 - 0.5) / 0.5).transpose(2, 0, 1)
    return out[None]


def cropped(image: np.ndarray, points: np.ndarray) -> np.ndarray:
    """The upright rectangle around a polygon; what lies outside the image is black."""
    (x0, y0), (x1, y1) = np.floor(points.min(0)).astype(int), np.ceil(points.max(0)).astype(int)
    if x1 <= x0 or y1 <= y0:
        raise ValueError("an empty box")
    out = np.zeros((y1 - y0, x1 - x0, 3), image.dtype)
    a, b, c, d = max(0, x0), max(0, y0), min(image.shape[1], x1), min(image.shape[0], y1)
    if c > a and d > b:
        out[b - y0 : d - y0, a - x0 : c - x0] = image[b:d, a:c]
    return out


def decoded(steps: np.ndarray, dictionary: list[str]) -> tuple[str, float]:
    """Greedy CTC over (steps, classes): repeats collapse, blanks part them; the mean probability of what was said."""
    text, sure, last = [], [], -1
    for label, p in zip(steps.argmax(1).tolist(), steps.max(1).tolist(), strict=True):
        if label and label != last:
            letter = " " if label == steps.shape[1] - 1 else dictionary[label - 1] if label <= len(dictionary) else ""
            if letter:
                text.append(letter)
                sure.append(p)
        last = label
    return "".join(text), float(np.mean(sure)) if sure else 0.0


@dataclass
class Box:
    points: np.ndarray
    score: float
    text: str = ""
    confidence: float = 0.0

    @property
    def side(self) -> float:
        return float(np.ptp(self.points, axis=0).min()) if len(self.points) else np.inf


def in_reading_order(boxes: list[Box], gap: float = LINE_GAP) -> list[Box]:
    """By lines, then from left to right. A line ends where the top is more than ``gap`` below the box before."""
    tops = sorted((float(b.points[:, 1].min()), float(b.points[:, 0].min()), k) for k, b in enumerate(boxes))
    lines, line, above = [], 0, None
    for top, left, k in tops:
        line += above is not None and top - above > gap
        above = top
        lines.append((line, left, top, k))
    return [boxes[k] for *_, k in sorted(lines)]


def _weight(text: str) -> int:
    """UTF-16 units that are not white space."""
    return sum(1 + (ord(c) > 0xFFFF) for c in text if not c.isspace())


@dataclass
class Runner:
    detect: Callable[[np.ndarray], np.ndarray]
    recognize: Callable[[np.ndarray], np.ndarray]
    dictionary: list[str]
    params: DBParams = field(default_factory=DBParams)
    side: int = DET_SIDE
    min_side: float = MIN_SIDE
    box_floor: float = BOX_CONFIDENCE
    doc_floor: float = DOC_CONFIDENCE

    def boxes(self, image: np.ndarray) -> list[Box]:
        """Detected boxes, best first, in the image's own pixels."""
        tensor, ratio_w, ratio_h = det_tensor(image, self.side)
        height, width = tensor.shape[2:]
        found = np.asarray(self.detect(tensor), np.float32).ravel()
        return [Box(np.asarray(p), s) for p, s in text_boxes(found, height, width, found.size // (height * width), self.params, ratio_w, ratio_h)]

    def read_box(self, image: np.ndarray, box: Box) -> None:
        """Fills in text and confidence; a box that fails is empty, and no other box feels it."""
        try:
            box.text, box.confidence = decoded(np.asarray(self.recognize(rec_tensor(cropped(image, box.points)))), self.dictionary)
        except Exception:
            box.text, box.confidence = "", 0.0

    def read(self, image: np.ndarray) -> tuple[list[Box], float]:
        """(boxes read with enough confidence, their mean confidence by text length). Small boxes are not read at all."""
        boxes = [b for b in self.boxes(image) if b.side >= self.min_side]
        for b in boxes:
            self.read_box(image, b)
        kept = [b for b in boxes if b.confidence >= self.box_floor]
        whole = sum(_weight(b.text) for b in kept)
        return kept, sum(b.confidence * _weight(b.text) for b in kept) / whole if whole else 0.0

    def page(self, image: np.ndarray) -> tuple[str, float]:
        """(text in reading order, a line per box; confidence). Text that is not sure enough is given up for a better engine."""
        kept, confidence = self.read(image)
        text = "\n".join(b.text for b in in_reading_order(kept))
        return ("" if text.strip() and confidence < self.doc_floor else text), confidence
