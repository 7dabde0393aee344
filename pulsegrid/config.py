"""Parameters of an analysis, checked where they are made."""

from __future__ import annotations

from dataclasses import dataclass, field, replace


@dataclass(frozen=True)
class Band:
    """A closed band of pulse frequencies."""

    low_hz: float = 0.7
    high_hz: float = 4.0

    def __post_init__(self):
        if not 0 < self.low_hz < self.high_hz:
            raise ValueError("a band needs 0 < low < high")

    @staticmethod
    def of_bpm(low: float, high: float) -> Band:
        return Band(low / 60, high / 60)


@dataclass(frozen=True)
class Analysis:
    """Window and step in seconds, filter order, detrending strength, least SNR in dB, smoothing and algorithm."""

    window_s: float = 10.0
    step_s: float = 1.0
    band: Band = field(default_factory=Band)
    order: int = 4
    detrend: float = 100.0
    least_snr_db: float = 0.0
    smoothing: float = 0.3
    algorithm: str = "pos"
    background: bool = True
    # frames without a face that a session outlasts; one more begins a new segment
    patience: int = 0
    # a background that explains nothing leaves the channel as it is; True doubles its level as the reference does
    double_level: bool = False

    def __post_init__(self):
        if self.window_s <= 0 or self.step_s <= 0 or self.order < 1:
            raise ValueError("window, step and order must be positive")

    def having(self, **changes) -> Analysis:
        return replace(self, **changes)

    def frames_in_window(self, fps: float) -> int:
        return max(2, round(self.window_s * fps))

    def frames_in_step(self, fps: float) -> int:
        return max(1, round(self.step_s * fps))


#: Defaults of the entry points.
LIBRARY = Analysis()
COMMAND = Analysis(window_s=25.0, band=Band.of_bpm(45, 200))
DIAGNOSTIC = Analysis(window_s=15.0, band=Band(0.75, 3.3))


@dataclass(frozen=True)
class Simulation:
    """One simulated recording."""

    bpm: float = 72.0
    duration_s: float = 20.0
    fps: float = 30.0
    width: int = 320
    height: int = 240
    pulse: float = 0.02
    harmonics: tuple[float, ...] = (1.0, 0.35, 0.12)
    noise: float = 2.0
    drift: float = 0.0
    tremor: float = 0.0
    tremor_hz: float = 0.2
    move_px: float = 0.0
    move_hz: float = 0.15
    skin_bgr: tuple[float, float, float] = (150.0, 175.0, 205.0)
    seed: int = 0
    jitter_s: float = 0.0
    phase: float = 0.0

    def __post_init__(self):
        if min(self.bpm, self.fps, self.duration_s) <= 0 or min(self.width, self.height) < 32:
            raise ValueError("rate, duration and frame rate must be positive and sides at least 32")


#: How strongly the pulse moves red, green and blue.
CHANNEL_GAINS = {"r": 0.30, "g": 1.00, "b": 0.55}
#: Error codes of a window, and the SNR in dB from which an estimate counts as high, medium or low.
ERRORS = ("janela_insuficiente", "fps_invalido", "banda_invalida", "rosto_nao_encontrado", "regiao_invalida", "fonte_indisponivel", "sinal_sem_qualidade")
CONFIDENCES = (("alta", 6.0), ("média", 2.0), ("baixa", 0.0), ("descartada", None))
