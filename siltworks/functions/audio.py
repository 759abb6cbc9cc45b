"""Audio as numpy arrays: decoding of WAV files, and the steps from samples to a masked mel spectrogram."""

from __future__ import annotations

import io
import wave

import numpy as np

#: Sample rate, window, mask bounds and mel bands.
RATE, N_FFT, MASK, MELS = 8000, 400, 80, 256


def read_wav(raw: bytes) -> tuple[np.ndarray, int]:
    """(samples in -1 to 1, mean of the channels; sample rate) of 8, 16 or 32 bit PCM. Other codecs are the caller's."""
    with wave.open(io.BytesIO(raw)) as w:
        kind = {1: np.uint8, 2: np.int16, 4: np.int32}[w.getsampwidth()]
        x = np.frombuffer(w.readframes(w.getnframes()), kind).astype(np.float64)
        x = (x - 128) / 128 if kind is np.uint8 else x / np.iinfo(kind).max
        return x.reshape(-1, w.getnchannels()).mean(1).astype(np.float32), w.getframerate()


def resample(x: np.ndarray, rate: int, to: int = RATE) -> np.ndarray:
    """By cutting or padding the spectrum."""
    n = int(np.ceil(len(x) * to / rate))
    if not len(x) or n == len(x):
        return x
    spectrum = np.fft.rfft(x)
    out = np.zeros(n // 2 + 1, complex)
    k = min(len(out), len(spectrum))
    out[:k] = spectrum[:k]
    return (np.fft.irfft(out, n) * (n / len(x))).astype(np.float32)


def _window(n: int) -> np.ndarray:
    return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)


def stft(x: np.ndarray, n_fft: int = N_FFT) -> np.ndarray:
    """Bins x frames; frames are centred, a quarter window apart, edges padded with zeros."""
    hop = n_fft // 4
    wide = np.pad(x, n_fft // 2)
    frames = np.lib.stride_tricks.sliding_window_view(wide, n_fft)[::hop]
    return np.fft.rfft(frames * _window(n_fft), axis=1).T


def istft(s: np.ndarray, length: int, n_fft: int = N_FFT) -> np.ndarray:
    hop, w = n_fft // 4, _window(n_fft)
    frames = np.fft.irfft(s.T, n_fft, axis=1) * w
    out = np.zeros(n_fft + hop * (len(frames) - 1))
    norm = np.zeros_like(out)
    for i, f in enumerate(frames):
        out[i * hop : i * hop + n_fft] += f
        norm[i * hop : i * hop + n_fft] += w * w
    out = out / np.where(norm > 1e-9, norm, 1)
    out = out[n_fft // 2 :][:length]
    return np.pad(out, (0, length - len(out))).astype(np.float32)


def spectrogram(x: np.ndarray, n_fft: int = N_FFT) -> np.ndarray:
    return np.abs(stft(x, n_fft)) ** 2


def time_stretch(x: np.ndarray, rate: float = 0.8, n_fft: int = N_FFT) -> np.ndarray:
    """A phase vocoder: the same pitches over 1 / rate times the time."""
    s = stft(x, n_fft)
    steps = np.arange(0, s.shape[1], rate)
    hop = n_fft // 4
    usual = np.linspace(0, np.pi * hop, s.shape[0])
    wide = np.pad(s, ((0, 0), (0, 2)))
    phase = np.angle(s[:, 0])
    out = np.empty((s.shape[0], len(steps)), complex)
    for t, at in enumerate(steps):
        a, b = wide[:, int(at)], wide[:, int(at) + 1]
        share = at % 1
        out[:, t] = ((1 - share) * np.abs(a) + share * np.abs(b)) * np.exp(1j * phase)
        change = np.angle(b) - np.angle(a) - usual
        phase = phase + usual + change - 2 * np.pi * np.round(change / (2 * np.pi))
    return istft(out, round(len(x) / rate), n_fft)


def stretched(spectrum: np.ndarray, rate: float = 0.8) -> np.ndarray:
    """Power spectra over 1 / rate times the time: magnitudes between frames as a phase vocoder has them; power has no phase."""
    at = np.arange(0, spectrum.shape[1], rate)
    wide = np.pad(np.sqrt(spectrum), ((0, 0), (0, 1)))
    share = at % 1
    return ((1 - share) * wide[:, at.astype(int)] + share * wide[:, at.astype(int) + 1]) ** 2


def time_mask(x: np.ndarray, rng: np.random.Generator, most: int = MASK) -> np.ndarray:
    return _masked(x, 1, rng, most)


def frequency_mask(x: np.ndarray, rng: np.random.Generator, most: int = MASK) -> np.ndarray:
    return _masked(x, 0, rng, most)


def _masked(x: np.ndarray, axis: int, rng: np.random.Generator, most: int) -> np.ndarray:
    """A band of less than `most` rows or columns is 0; its start is uniform."""
    n = min(int(rng.uniform(0, most)), x.shape[axis])
    start = int(rng.integers(0, x.shape[axis] - n + 1))
    out = x.copy()
    out[(slice(start, start + n), slice(None)) if axis == 0 else (slice(None), slice(start, start + n))] = 0
    return out


def mel_bands(rate: int = RATE, n_fft: int = N_FFT, bands: int = MELS) -> np.ndarray:
    """Triangles over the bins, evenly placed on a scale that is linear below 1000 Hz and logarithmic above, each of equal area."""
    step = np.log(6.4) / 27
    to_mel = lambda f: np.where(f < 1000, f * 3 / 200, 15 + np.log(np.maximum(f, 1e-9) / 1000) / step)
    to_hz = lambda m: np.where(m < 15, m * 200 / 3, 1000 * np.exp(step * (m - 15)))
    edge = to_hz(np.linspace(0, float(to_mel(np.float64(rate / 2))), bands + 2))
    bins = np.linspace(0, rate / 2, n_fft // 2 + 1)
    up = (bins - edge[:-2, None]) / np.diff(edge)[:-1, None]
    down = (edge[2:, None] - bins) / np.diff(edge)[1:, None]
    return np.maximum(0, np.minimum(up, down)) * (2 / (edge[2:] - edge[:-2]))[:, None]


def mel(spectrum: np.ndarray, rate: int = RATE, n_fft: int = N_FFT, bands: int = MELS) -> np.ndarray:
    return mel_bands(rate, n_fft, bands) @ spectrum


def speech_features(raw: bytes, rng: np.random.Generator) -> np.ndarray:
    """Decode, resample, stretch, spectrogram, time mask, frequency mask, mel."""
    x, rate = read_wav(raw)
    s = spectrogram(time_stretch(resample(x, rate)))
    return mel(frequency_mask(time_mask(s, rng), rng))
