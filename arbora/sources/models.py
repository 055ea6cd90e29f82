"""What segmentation models answer, as aligned masks, boxes and scores; and models as backends that executors load once."""

from __future__ import annotations

import importlib
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any, NamedTuple

import numpy as np

from . import formats


class Found(NamedTuple):
    """Masks (n, height, width), boxes (n, 4) with exclusive ends, scores (n,)."""

    masks: np.ndarray
    boxes: np.ndarray
    scores: np.ndarray


def nothing(height: int, width: int) -> Found:
    return Found(np.zeros((0, height, width), dtype=bool), np.zeros((0, 4), dtype=np.float32), np.zeros(0, dtype=np.float32))


def _boxed(masks: list[np.ndarray], scores: list[float], height: int, width: int) -> Found:
    """Masks with the boxes of their pixels; empty masks go."""
    held = [(m, b, s) for m, s in zip(masks, scores, strict=True) if (b := formats.mask_box(m)) is not None]
    if not held:
        return nothing(height, width)
    return Found(np.stack([m for m, _, _ in held]), np.array([b for _, b, _ in held], dtype=np.float32), np.array([s for *_, s in held], dtype=np.float32))


def _array(x: Any) -> np.ndarray:
    """An array, also of a tensor that a device holds."""
    for step in ("detach", "cpu", "numpy"):
        x = getattr(x, step)() if hasattr(x, step) else x
    return np.asarray(x)


def class_name(label: int, names: Mapping[Any, str]) -> str:
    """A label's name by its number or by that number as text; else the number."""
    return str(names.get(label) or names.get(str(label)) or label)


def from_segments(segmentation: Any, segments: Sequence[Mapping[str, Any]], names: Mapping[Any, str], text: str | None = None) -> Found:
    """One mask for each segment of a map (height, width) whose class name holds the text; segments without an id of 0 or more, or without pixels, go."""
    plane = _array(segmentation).astype(np.int64) if segmentation is not None else np.zeros((0, 0), dtype=np.int64)
    if not plane.size:
        return nothing(*plane.shape[:2])
    sought = text.casefold().strip() if text else ""
    wanted = [s for s in segments if int(s.get("id", -1)) >= 0 and sought in class_name(int(s.get("label_id", -1)), names).casefold()]
    return _boxed([plane == int(s["id"]) for s in wanted], [float(s.get("score", 1.0)) for s in wanted], *plane.shape)


def from_stacks(masks: Any, scores: Any = None) -> Found:
    """Masks of one or several candidates a prompt, (n[, candidates], height, width); of several the one of the best score, or the first without fitting scores.

    Axes of one at the front go; a score is 1 where there is none.
    """
    m = _array(masks)
    s = None if scores is None else _array(scores)
    while m.ndim > 4 and m.shape[0] == 1:
        m = m[0]
    while s is not None and s.ndim > 2 and s.shape[0] == 1:
        s = s[0]
    if m.ndim == 2:
        m = m[None]
    if m.ndim == 4:
        if s is not None and s.ndim == 2 and s.shape == m.shape[:2]:
            best, each = s.argmax(axis=1), np.arange(len(m))
            m, s = m[each, best], s[each, best]
        else:
            m, s = m[:, 0], None
    if m.ndim != 3:
        return nothing(0, 0)
    fits = s is not None and s.ndim == 1 and len(s) == len(m)
    return _boxed(list(m.astype(bool)), [float(x) for x in s] if fits else [1.0] * len(m), *m.shape[1:])


def from_result(result: Mapping[str, Any]) -> Found:
    """A result's own masks (n[, 1], height, width), boxes and scores; raises ValueError if one is missing or their shapes are wrong."""
    parts = [result.get(k) for k in ("masks", "boxes", "scores")]
    if any(p is None for p in parts):
        raise ValueError("a result needs masks, boxes and scores")
    masks, boxes, scores = map(_array, parts)
    if not len(masks):
        return nothing(*(masks.shape[-2:] if masks.ndim >= 3 else (0, 0)))
    if masks.ndim == 4:
        masks = masks[:, 0]
    if masks.ndim != 3 or boxes.shape != (len(masks), 4) or scores.shape != (len(masks),):
        raise ValueError(f"masks, boxes and scores don't fit: {masks.shape}, {boxes.shape}, {scores.shape}")
    return Found(masks.astype(bool), boxes.astype(np.float32), scores.astype(np.float32))


def confident(found: Found, threshold: float, fallback: bool = True) -> Found:
    """Those of a score from the threshold on; with fallback, if there are none, the first of the best score."""
    keep = np.nonzero(found.scores >= threshold)[0]
    if not len(keep) and fallback and len(found.scores):
        keep = np.array([int(found.scores.argmax())])
    return Found(*(x[keep] for x in found))


_loaded: dict[str, Any] = {}


def loaded(key: str, make: Callable[[], Any]) -> Any:
    """What make gives, made once in a process."""
    if key not in _loaded:
        _loaded[key] = make()
    return _loaded[key]


#: How an answer becomes Found, by a model's family; names are a segment model's classes.
DECODERS: dict[str, Callable[[Any, Mapping[Any, str], str | None], Found]] = {
    "segments": lambda answer, names, text: from_segments(answer.get("segmentation"), answer.get("segments_info") or (), names, text),
    "stacks": lambda answer, names, text: from_stacks(answer["masks"], answer.get("scores")),
    "result": lambda answer, names, text: from_result(answer),
}


@dataclass(frozen=True)
class ModelBackend:
    """A model as a backend: make() gives, once in an executor's process, a function of pixels, text, boxes and points, whose answers are decoded by family.

    setup is called before make, for what a device needs.
    """

    key: str
    make: Callable[[], Callable[..., Any]]
    family: str = "result"
    names: Mapping[Any, str] = field(default_factory=dict)
    setup: Callable[[], None] | None = None
    reads_text: bool = True

    def predict(self, pixels: np.ndarray, text: str | None, boxes: list[list[float]], points: list[list[float]]) -> Found:
        def first() -> Callable[..., Any]:
            if self.setup is not None:
                self.setup()
            return self.make()

        return DECODERS[self.family](loaded(self.key, first)(pixels, text, boxes, points), self.names, text)


def backend_of(name: str) -> Any:
    """A backend by module:attribute; a function or class is called for it."""
    module, _, attribute = name.partition(":")
    if not attribute:
        raise ValueError(f"a backend is named module:attribute, not {name!r}")
    try:
        found = getattr(importlib.import_module(module), attribute)
    except (ImportError, AttributeError) as e:
        raise ValueError(f"no backend {name!r}: {e}") from None
    return found if hasattr(found, "predict") and not isinstance(found, type) else found()


def fetch(url: str, path: str, told: Callable[[int, int], None] | None = None) -> int:
    """Download a model's file in pieces, under its name only when it is whole; told(bytes, of all) after each piece; the number of bytes."""
    import os
    import urllib.request

    part, n = f"{path}.part", 0
    with urllib.request.urlopen(url) as source, open(part, "wb") as out:
        total = int(source.headers.get("Content-Length") or 0)
        while piece := source.read(1 << 20):
            out.write(piece)
            n += len(piece)
            if told is not None:
                told(n, total)
    if total and n != total:
        os.unlink(part)
        raise OSError(f"{url} ended after {n} of {total} bytes")
    os.replace(part, path)
    return n
