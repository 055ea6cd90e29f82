"""Overlays drawn into pixel arrays with NumPy: discs, rings, boxes, masks and small texts."""

from __future__ import annotations

import numpy as np

#: The colours of crowns and boxes, and those of detections by their place.
CROWN, BOX = (216, 88, 245), (245, 224, 88)
PALETTE = ((255, 255, 0), (255, 155, 0), (255, 128, 128), (255, 102, 178), (255, 102, 255), (178, 102, 255), (153, 153, 255), (51, 153, 255), (102, 255, 255), (51, 255, 153), (102, 255, 102), (153, 255, 0))
#: Letters of three by five pixels, a digit a row, bits from the left.
GLYPHS = {
    "0": "75557", "1": "26227", "2": "71747", "3": "71717", "4": "55711", "5": "74717", "6": "74757", "7": "71111", "8": "75757", "9": "75717", ".": "00002", "-": "00700", "_": "00007", ",": "00024", ":": "02020",
    "A": "25755", "B": "65656", "C": "34443", "D": "65556", "E": "74647", "F": "74644", "G": "34553", "H": "55755", "I": "72227", "J": "11152", "K": "55655", "L": "44447", "M": "57755",
    "N": "65555", "O": "25552", "P": "65644", "Q": "25563", "R": "65655", "S": "34216", "T": "72222", "U": "55557", "V": "55552", "W": "55775", "X": "55255", "Y": "55222", "Z": "71247",
}


def rgb(pixels: np.ndarray) -> np.ndarray:
    """A copy with three channels: gray three times, the first three of more."""
    return np.repeat(pixels, 3, axis=2) if pixels.shape[2] < 3 else pixels[:, :, :3].copy()


def tint(pixels: np.ndarray, where: np.ndarray, colour: tuple[int, int, int], alpha: float) -> None:
    """Blend a colour into the pixels of a mask."""
    pixels[where] = np.round(pixels[where] * (1 - alpha) + np.array(colour) * alpha).astype(np.uint8)


def disc(pixels: np.ndarray, x: float, y: float, radius: float, colour: tuple[int, int, int], alpha: float, stroke: int) -> None:
    """A filled circle with an opaque rim; only its own rectangle is touched."""
    h, w = pixels.shape[:2]
    reach = radius + stroke
    x0, x1, y0, y1 = max(0, int(x - reach)), min(w, int(x + reach) + 2), max(0, int(y - reach)), min(h, int(y + reach) + 2)
    if x1 <= x0 or y1 <= y0:
        return
    far = np.hypot(np.arange(x0, x1)[None, :] - x, np.arange(y0, y1)[:, None] - y)
    part = pixels[y0:y1, x0:x1]
    tint(part, far <= radius, colour, alpha)
    tint(part, np.abs(far - radius) <= stroke / 2, colour, 1.0)


def rectangle(pixels: np.ndarray, x1: int, y1: int, x2: int, y2: int, colour: tuple[int, int, int], stroke: int) -> None:
    """A box's rim, inside the picture."""
    h, w = pixels.shape[:2]
    x1, x2, y1, y2 = max(0, min(w - 1, x1)), max(0, min(w - 1, x2)), max(0, min(h - 1, y1)), max(0, min(h - 1, y2))
    back, on = stroke // 2, stroke - stroke // 2
    for y in (y1, y2):
        pixels[max(0, y - back) : y + on, max(0, x1 - back) : x2 + on] = colour
    for x in (x1, x2):
        pixels[max(0, y1 - back) : y2 + on, max(0, x - back) : x + on] = colour


def caption(pixels: np.ndarray, x: int, y: int, text: str, colour: tuple[int, int, int], pad: int = 2) -> None:
    """A text in black on a coloured plate whose lower left corner is at x, y."""
    h, w = pixels.shape[:2]
    plate = np.zeros((5 + 2 * pad, 4 * len(text) - 1 + 2 * pad), dtype=bool)
    for k, c in enumerate(text.upper()):
        rows = [[int(b) for b in f"{int(d):03b}"] for d in GLYPHS.get(c, "00000")]
        plate[pad : pad + 5, pad + 4 * k : pad + 4 * k + 3] = rows
    x0, y0 = max(0, min(x, w - plate.shape[1])), max(0, y - plate.shape[0])
    part = pixels[y0 : y0 + plate.shape[0], x0 : x0 + plate.shape[1]]
    cut = plate[: part.shape[0], : part.shape[1]]
    part[~cut], part[cut] = colour, 0


def draw_labels(pixels: np.ndarray, trees: list[dict], stroke: int = 1) -> np.ndarray:
    """A tile with its trees' crowns and boxes; trees have x_pixel, y_pixel, crown_radius and bbox_x1 to bbox_y2."""
    out = rgb(pixels)
    h, w = out.shape[:2]
    for t in trees:
        x, y = max(0, min(w - 1, round(t["x_pixel"]))), max(0, min(h - 1, round(t["y_pixel"])))
        disc(out, x, y, max(1, round(t["crown_radius"])), CROWN, 0.3, max(1, 2 * stroke))
        x1, y1, x2, y2 = (round(t[c]) for c in ("bbox_x1", "bbox_y1", "bbox_x2", "bbox_y2"))
        rectangle(out, x1, y1, max(x2, x1 + 1), max(y2, y1 + 1), BOX, max(1, 2 * stroke))
    return out


def draw_detections(pixels: np.ndarray, masks: np.ndarray, boxes: np.ndarray, scores: np.ndarray, label: str | None = None) -> np.ndarray:
    """A picture with masks, boxes and, under a label, captions; larger masks are drawn first, colours go by place."""
    out = rgb(pixels)
    for k in np.argsort([-int(m.sum()) for m in masks], kind="stable"):
        tint(out, masks[k], PALETTE[k % len(PALETTE)], 0.6)
    for k, b in enumerate(boxes):
        rectangle(out, *(int(v) for v in b), PALETTE[k % len(PALETTE)], 1)
    for k, (b, s) in enumerate(zip(boxes, scores, strict=True)):
        if label:
            caption(out, int(b[0]), int(b[1]), f"{label} {s:.2f}", PALETTE[k % len(PALETTE)])
    return out
