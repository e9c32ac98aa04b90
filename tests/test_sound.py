"""Sound placed, filled with silence, mixed down and written, against plain loops."""

import math
import random
import tempfile
import wave

import numpy as np
import pytest

from sparkreel.operators import sound


def plain_mix(frame):
    """One frame of samples as two, by the rules for its number of channels."""
    n, half = len(frame), math.sqrt(0.5)
    if n < 3:
        return list(frame)
    left, right = frame[0] + frame[2] * half, frame[1] + frame[2] * half
    if n >= 6:
        left, right = left + frame[4] * half, right + frame[5] * half
    elif n == 5:
        left, right = left + frame[3] * half, right + frame[4] * half
    elif n == 4:
        left, right = left + frame[3] * half, right + frame[3] * half
    return [max(-32768, min(32767, math.floor(v + 0.5))) for v in (left, right)]


@pytest.mark.parametrize("channels", [1, 2, 3, 4, 5, 6])
def test_mixing_down(channels):
    frames = np.random.default_rng(channels).integers(-32768, 32768, (300, channels)).astype(np.int16)
    assert sound.mixed_down(frames).tolist() == [plain_mix([int(v) for v in f]) for f in frames]


def test_seconds_of_sound_and_their_files(spark):
    r = random.Random(6)
    rate, blocks, asks = 20, [], [("a", 0, 0.5, 5.13), ("a", 1, 90.0, 1.0), ("b", 0, 0.0, 3.0), ("none", 0, 0.0, 9.0)]
    for g, channels in (("a", 6), ("b", 1)):
        for k, stamp in enumerate((-0.4, 0.9, 1.45, 3.3, 3.3)):  # gaps, overlaps, one before the beginning
            n = r.randrange(10, 45)
            blocks.append((g, k, stamp, rate, channels, [r.randrange(-32768, 32768) for _ in range(n * channels)]))
    df = spark.createDataFrame(blocks, "g string, block long, stamp double, rate long, channels long, samples array<smallint>").repartition(3)
    out = sound.seconds_of_sound(df, spark.createDataFrame(asks, "g string, ask long, start double, duration double"), "g")
    got = {}
    for x in sorted(out.collect(), key=lambda x: (x["g"], x["ask"], x["second"])):
        got.setdefault((x["g"], x["ask"]), []).append(bytes(x["content"]))
        assert (x["rate"], x["channels"]) == (rate, 2 if x["g"] == "a" else 1)
    want = {}
    for g, k, start, duration in asks[:1] + asks[2:3]:
        channels = next(b[4] for b in blocks if b[0] == g)
        frames = [[0] * channels for _ in range(max(1, math.floor(duration * rate + 0.5)))]
        for _, _, stamp, _, _, samples in (b for b in blocks if b[0] == g):
            n, stop = len(samples) // channels, start + duration
            if stamp >= stop or stamp + n / rate <= start:
                continue
            a = math.floor((start - stamp) * rate + 0.5) if stamp < start else 0
            b = math.floor((stop - stamp) * rate + 0.5) if stamp + n / rate > stop else n
            at = max(0, math.floor((stamp + a / rate - start) * rate + 0.5))
            for i in range(a, b):
                if at + i - a < len(frames):
                    frames[at + i - a] = samples[i * channels : (i + 1) * channels]
        want[g, k] = np.array([plain_mix(f) for f in frames], "<i2").tobytes()
    assert {k: b"".join(v) for k, v in got.items()} == want
    assert [len(x) for x in got["a", 0]] == [80] * 5 + [12]
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    sound.write_wavs(out.where("ask = 0"), "g", folder)
    for g in "ab":
        with wave.open(f"{folder}/{g}.wav") as w:
            assert (w.getframerate(), w.getsampwidth(), w.getnchannels()) == (rate, 2, 2 if g == "a" else 1) and w.readframes(w.getnframes()) == want[g, 0]
