"""Settings with their bounds and defaults."""

from __future__ import annotations

import hashlib
import json
import os
from dataclasses import asdict, dataclass, field, fields

RESIZE_METHODS = ("Crop", "Padding", "Stretch")
SAMPLINGS = ("NearestNeighbor", "Bilinear", "Bicubic", "Lanczos", "MitchellNetravali")
OUTPUT_FORMATS = ("PNG", "JPEG", "BMP", "TIFF", "WebP")
LAYOUTS = ("NCHW", "NHWC")


@dataclass(frozen=True)
class Normalisation:
    """Channel means and deviations of a model's input."""

    mean: tuple[float, float, float] = (0.485, 0.456, 0.406)
    std: tuple[float, float, float] = (0.229, 0.224, 0.225)


#: The usual presets.
IMAGENET = Normalisation()
CLIP = Normalisation((0.48145466, 0.4578275, 0.40821073), (0.26862954, 0.26130258, 0.27577711))


#: Settings that change pixels or tensors, and so features; the model's path counts where it is used.
_FOR_FEATURES = ("use_bundled_model", "layout", "normalisation", "resize", "size", "resize_method", "padding_colour", "downsampling", "upsampling", "companding", "detect_borders", "border_tolerance", "output_format")
#: Bounds of a side of the model's input.
SIZES = (32, 2048)


def clamp(value, low, high):
    return max(low, min(high, value))


@dataclass(frozen=True)
class Settings:
    parallelism: int = field(default_factory=lambda: os.cpu_count() or 1)
    batch_size: int = 16
    resize: bool = True
    size: int = 320
    resize_method: str = "Stretch"
    padding_colour: int = 0xFFFFFFFF
    downsampling: str = "Lanczos"
    upsampling: str = "Lanczos"
    companding: bool = False
    detect_borders: bool = True
    border_tolerance: int = 80
    output_format: str = "JPEG"
    model_path: str = ""
    use_bundled_model: bool = True
    layout: str = "NCHW"
    normalisation: Normalisation = IMAGENET
    threshold: float = 0.75
    auto_analyse: bool = True

    def __post_init__(self):
        put = lambda k, v: object.__setattr__(self, k, v)
        put("parallelism", clamp(int(self.parallelism), 1, os.cpu_count() or 1))
        put("batch_size", clamp(int(self.batch_size), 1, 64))
        put("threshold", clamp(float(self.threshold), 0.3, 1.0))
        put("size", clamp(int(self.size), *SIZES))
        put("border_tolerance", clamp(int(self.border_tolerance), 0, 255))
        for value, allowed in ((self.resize_method, RESIZE_METHODS), (self.downsampling, SAMPLINGS), (self.upsampling, SAMPLINGS), (self.output_format, OUTPUT_FORMATS), (self.layout, LAYOUTS)):
            if value not in allowed:
                raise ValueError(f"{value!r} is none of {allowed}")

    def with_threshold(self, value: float) -> Settings:
        """Another threshold; a change of at most 0.001 is none."""
        value = clamp(float(value), 0.3, 1.0)
        return self if abs(value - self.threshold) <= 0.001 else Settings(**(self._plain() | {"threshold": value}))

    def bundled_defaults(self) -> Settings:
        """These settings with what the bundled model wants."""
        return Settings(**(self._plain() | {"use_bundled_model": True, "resize": True, "size": 320, "resize_method": "Stretch", "downsampling": "Bilinear", "upsampling": "Bilinear", "companding": False, "output_format": "PNG", "layout": "NCHW", "normalisation": IMAGENET}))

    def affects_features(self, other: Settings) -> bool:
        """Whether another model or input of the model makes features of these settings void at once."""
        return any(getattr(self, k) != getattr(other, k) for k in ("use_bundled_model", "model_path", "layout", "normalisation"))

    def features_digest(self) -> str:
        """A digest of what features depend on: the model, its input, and how images are prepared for it."""
        held = asdict(self)
        model = "" if self.use_bundled_model else self.model_path
        return hashlib.sha256(json.dumps([model, *(held[k] for k in _FOR_FEATURES)], sort_keys=True).encode()).hexdigest()[:32]

    def _plain(self) -> dict:
        return {f.name: getattr(self, f.name) for f in fields(self)}

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text: str) -> Settings:
        held = json.loads(text)
        if "normalisation" in held:
            held["normalisation"] = Normalisation(*(tuple(held["normalisation"][k]) for k in ("mean", "std")))
        return cls(**held)
