"""Arithmetic about frames, sizes and subtitle times, as SQL text; decoding itself is left to a plugged-in reader."""

from __future__ import annotations

FACTOR, MIN_PIXELS, MAX_PIXELS = 28, 4 * 28 * 28, 16384 * 28 * 28


def smart_resize(h: str, w: str, factor: int = FACTOR, low: int = MIN_PIXELS, high: int = MAX_PIXELS) -> tuple[str, str]:
    """Height and width as multiples of the factor, with a number of pixels within bounds and nearly the same shape."""
    near = lambda x: f"greatest({factor}, CAST(rint({x} / {factor}D) AS bigint) * {factor})"
    area, shape = f"({near(h)}) * ({near(w)})", f"({h} * CAST({w} AS double))"

    def side(x: str) -> str:
        down = f"greatest({factor}, CAST(floor({x} / sqrt({shape} / {high}) / {factor}) AS bigint) * {factor})"
        up = f"CAST(ceil({x} * sqrt({low} / {shape}) / {factor}) AS bigint) * {factor}"
        return f"CASE WHEN {area} > {high} THEN {down} WHEN {area} < {low} THEN {up} ELSE {near(x)} END"

    return side(h), side(w)


def frame_indices(frames: str, video_fps: str, fps: int, most: int) -> str:
    """Indices of the frames to read: every so many, or evenly spread ones if that would be too many."""
    step = f"greatest(1, CAST({video_fps} AS bigint) DIV {fps})"
    every = f"sequence(0L, {frames} - 1, {step})"
    spread = f"transform(sequence(0L, {most} - 1L), i -> i * ({frames} - 1) DIV {most - 1})"
    return f"CASE WHEN {frames} <= 0 THEN array() WHEN ({frames} + {step} - 1) DIV {step} > {most} THEN {spread} ELSE {every} END"


def srt_time(seconds: str) -> str:
    """``HH:MM:SS,mmm``."""
    part = lambda x, n: f"lpad(CAST({x} AS string), {n}, '0')"
    ms = f"CAST(round({seconds} * 1000) AS bigint)"
    return f"concat({part(f'{ms} DIV 3600000', 2)}, ':', {part(f'{ms} DIV 60000 % 60', 2)}, ':', {part(f'{ms} DIV 1000 % 60', 2)}, ',', {part(f'{ms} % 1000', 3)})"


def probe_duration(text: str) -> str:
    """Seconds of the line ``Duration: h:m:s.cs`` of a probe's output."""
    g = lambda k: f"CAST(regexp_extract({text}, 'Duration:\\\\s*([0-9]+):([0-9]+):([0-9]+(?:[.][0-9]+)?)', {k}) AS double)"
    return f"CASE WHEN {text} RLIKE 'Duration:\\\\s*[0-9]+:[0-9]+:[0-9]' THEN {g(1)} * 3600 + {g(2)} * 60 + {g(3)} END"
