"""Refusals. Configuration errors raise on the driver; data errors become an ``error`` column."""

from __future__ import annotations

#: The codes and their messages.
MESSAGES = {
    "EmptyChannelMask": "channel mask has no enabled channels",
    "SampleLengthMismatch": "sample length is zero or not a multiple of enabled channel count",
    "InvalidWindow": "window and hop must be non-zero",
    "WindowTooLarge": "window exceeds samples per channel",
    "InvalidThreshold": "artifact threshold must be positive",
    "InvalidConfidence": "confidence exceeds 1000 permille",
    "EmptyInput": "DSP input buffer is empty",
    "EmptyKernel": "filter kernel has no coefficients",
    "OutputLengthMismatch": "output buffer length does not match input length",
    "InvalidShift": "fixed-point shift amount must be in 0..=31",
    "InvalidDecimation": "decimation factor is zero or would leave no samples",
    "AliasingRisk": "the decimated Nyquist does not exceed the declared band limit; content above it would fold into the surviving band",
    "UnsupportedSampleRate": "sample rate has no tabulated filter design",
    "InvalidCoefficient": "fixed-point filter coefficient is out of range",
    "DimensionMismatch": "vectors have mismatched dimensions",
    "EmptyClassSet": "classifier has no class references",
}


class PipelineError(ValueError):
    """A refused configuration; ``code`` names the reason."""

    def __init__(self, code: str):
        super().__init__(MESSAGES[code])
        self.code = code


def refuse(condition: bool, code: str) -> None:
    if condition:
        raise PipelineError(code)
