"""Configurations of data, encoder, model and training: closed field sets, guards, fingerprints."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Mapping
from dataclasses import asdict, dataclass, fields
from typing import Any

from texweave.functions.vocabulary import BOS, EOS, PAD, UNK
from texweave.operators.policy import Policy

# Fixed values of the formats.
STAGE_NAMES = ("stage1", "stage2", "stage3", "stage4")
CHECKPOINT_NAME = "best-{epoch:02d}-{step}-{metric:.4f}"
WORKER_SEEDS = 2**32


class ConfigError(ValueError):
    """A configuration breaks a guard."""


def require(holds: bool, what: str) -> None:
    if not holds:
        raise ConfigError(what)


def canonical_json(value: Any) -> str:
    """Sorted keys and no white space: equal values give equal text."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"))


def fingerprint(value: Any) -> str:
    return hashlib.sha256(canonical_json(value).encode()).hexdigest()


def known_fields(kind: type, values: Mapping[str, Any]) -> dict[str, Any]:
    """The entries of ``values`` that ``kind`` has a field for; others are left out."""
    return {f.name: values[f.name] for f in fields(kind) if f.name in values}


def closed_fields(kind: type, name: str, values: Mapping[str, Any]) -> dict[str, Any]:
    """``values`` cast to the types of ``kind``; a missing or unexpected key is an error that names both."""
    wanted = {f.name: f.type for f in fields(kind)}
    missing, unexpected = sorted(wanted.keys() - values.keys()), sorted(values.keys() - wanted.keys())
    require(not missing and not unexpected, f"{name}: missing {missing}, unexpected {unexpected}")
    return {k: {"int": int, "bool": bool}[kind](values[k]) for k, kind in wanted.items()}


@dataclass(frozen=True)
class DataConfig:
    """Where the splits are and how they are batched."""

    name: str = "default"
    train_manifest: str | None = None
    val_manifest: str | None = None
    test_manifest: str | None = None
    batch_size: int = 16
    num_workers: int = 4
    max_sequence_length: int = 1027
    unknown_policy: str = "error"
    overlength_policy: str = "error"
    shuffle: bool = True
    streaming: bool = False
    shuffle_buffer_size: int = 1
    seed: int = 42
    pin_memory: bool = False
    image_size: int = 384

    def __post_init__(self) -> None:
        require(self.batch_size > 0, "batch_size is not positive")
        require(self.num_workers >= 0, "num_workers is negative")
        require(self.image_size > 0, "image_size is not positive")
        self.policy()

    @classmethod
    def of(cls, values: Mapping[str, Any]) -> DataConfig:
        return cls(**known_fields(cls, values))

    def policy(self) -> Policy:
        return Policy(self.max_sequence_length, self.unknown_policy, self.overlength_policy)


@dataclass(frozen=True)
class Stage:
    in_channels: int
    mid_channels: int
    out_channels: int
    num_blocks: int
    num_layers: int
    kernel_size: int
    downsample: bool
    use_light_conv: bool


@dataclass(frozen=True)
class EncoderConfig:
    """The encoder's architecture; every field counts for its fingerprint."""

    stage_config: Mapping[str, Stage]
    image_size: int = 384
    input_channels: int = 3
    stem_channels: tuple[int, ...] = (3, 32, 48)
    hidden_size: int = 2048
    activation: str = "relu"
    batch_norm_eps: float = 1e-5
    initialization: str = "pytorch_default"

    def __post_init__(self) -> None:
        require(self.image_size > 0 and self.image_size % 32 == 0, "image_size is no positive multiple of 32")
        require(len(self.stem_channels) == 3, "stem_channels are input, middle and output")
        require(self.stem_channels[0] == self.input_channels, "the stem does not take input_channels")
        require(self.activation == "relu", "only relu is known")
        require(self.initialization == "pytorch_default", "the initialization is not known")
        require(self.batch_norm_eps > 0, "batch_norm_eps is not positive")
        require(tuple(self.stage_config) == STAGE_NAMES, f"stages must be {', '.join(STAGE_NAMES)} in this order")
        given = self.stem_channels[-1]
        for name, stage in self.stage_config.items():
            require(stage.in_channels == given, f"{name} does not take what comes before it")
            sizes = {k: v for k, v in asdict(stage).items() if not isinstance(v, bool)}
            wrong = [k for k, v in sizes.items() if v <= 0]
            require(not wrong, f"{name}: {wrong} not positive")
            require(stage.kernel_size % 2 == 1, f"{name}: an even kernel_size")
            given = stage.out_channels
        require(given == self.hidden_size, "hidden_size is not what the last stage gives")

    @classmethod
    def of(cls, values: Mapping[str, Any]) -> EncoderConfig:
        """From a mapping; ``input_size`` and ``encoder_hidden_size`` stand in for the first two where these are missing."""
        stages = {str(k): Stage(**closed_fields(Stage, str(k), v)) for k, v in values["stage_config"].items()}
        return cls(
            stages,
            int(values["image_size"] if "image_size" in values else values["input_size"]),
            int(values.get("input_channels", cls.input_channels)),
            tuple(map(int, values["stem_channels"])),
            int(values["hidden_size"] if "hidden_size" in values else values["encoder_hidden_size"]),
            str(values["activation"]),
            float(values.get("batch_norm_eps", cls.batch_norm_eps)),
            str(values.get("initialization", cls.initialization)),
        )

    def architecture(self) -> dict[str, Any]:
        told = {f.name: getattr(self, f.name) for f in fields(self)}
        return told | {"stage_config": {k: asdict(v) for k, v in self.stage_config.items()}, "stem_channels": list(self.stem_channels)}

    @property
    def sha256(self) -> str:
        return fingerprint(self.architecture())


@dataclass(frozen=True)
class ModelConfig:
    """Encoder and decoder; the output layer is not tied to the embeddings."""

    encoder: EncoderConfig
    vocab_size: int = 687
    decoder_hidden_size: int = 384
    decoder_layers: int = 2
    decoder_attention_heads: int = 16
    decoder_ffn_dim: int = 1536
    max_position_embeddings: int = 1027
    bos_token_id: int = BOS
    pad_token_id: int = PAD
    eos_token_id: int = EOS
    unk_token_id: int = UNK
    decoder_start_token_id: int = BOS
    decoder_dropout: float = 0.1
    decoder_attention_dropout: float = 0.0
    decoder_activation_dropout: float = 0.0
    decoder_layer_norm_eps: float = 1e-5
    decoder_scale_embedding: bool = True
    tie_word_embeddings: bool = False

    def __post_init__(self) -> None:
        sizes = ("vocab_size", "decoder_hidden_size", "decoder_layers", "decoder_attention_heads", "decoder_ffn_dim", "max_position_embeddings")
        wrong = [k for k in sizes if getattr(self, k) <= 0]
        require(not wrong, f"{wrong} not positive")
        require(self.decoder_hidden_size % self.decoder_attention_heads == 0, "decoder_hidden_size does not divide among its heads")
        special = [self.bos_token_id, self.pad_token_id, self.eos_token_id, self.unk_token_id]
        require(all(x is not None and 0 <= x < self.vocab_size for x in (*special, self.decoder_start_token_id)), "a special id is outside the vocabulary")
        require(len(set(special)) == len(special), "special ids are not distinct")
        require(self.decoder_start_token_id == self.bos_token_id, "decoding does not start with BOS")
        require(not self.tie_word_embeddings, "the output layer must not be tied")

    @classmethod
    def of(cls, values: Mapping[str, Any]) -> ModelConfig:
        """From a mapping that holds the encoder's fields as well; sizes, ids and the tie must be given."""
        optional = {f.name for f in fields(cls) if "dropout" in f.name or f.name in ("decoder_layer_norm_eps", "decoder_scale_embedding")}
        kinds = {"int": int, "float": float, "bool": bool}
        own = {f.name: kinds[f.type](values[f.name]) for f in fields(cls) if f.name != "encoder" and not (f.name in optional and f.name not in values)}
        return cls(EncoderConfig.of(values), **own)

    @property
    def encoder_hidden_size(self) -> int:
        return self.encoder.hidden_size

    def decoder(self) -> dict[str, Any]:
        """The decoder's part, as an attention decoder that reads the encoder takes it."""
        names = {"d_model": "decoder_hidden_size", "dropout": "decoder_dropout", "attention_dropout": "decoder_attention_dropout", "activation_dropout": "decoder_activation_dropout"}
        names |= {"layer_norm_eps": "decoder_layer_norm_eps", "scale_embedding": "decoder_scale_embedding", "forced_eos_token_id": "eos_token_id"}
        same = ("vocab_size", "max_position_embeddings", "decoder_layers", "decoder_attention_heads", "decoder_ffn_dim", "bos_token_id", "pad_token_id", "eos_token_id", "decoder_start_token_id", "tie_word_embeddings")
        names |= {k: k for k in same}
        return {k: getattr(self, v) for k, v in names.items()} | {"is_decoder": True, "is_encoder_decoder": False, "add_cross_attention": True}


#: What each mode asks of (a path to pretrained weights, a checkpoint to resume).
_MODES = {"scratch": (False, False), "pretrained": (True, False)}


def initialization_mode(training: Mapping[str, Any]) -> str:
    """``scratch``, ``pretrained`` or ``resume``: a checkpoint to resume always wins and excludes pretrained weights."""
    mode = str(training["init_mode"])
    weights, checkpoint = (training.get(k) is not None for k in ("pretrained_path", "resume_from_checkpoint"))
    if checkpoint:
        require(mode != "pretrained" and not weights, "resuming and pretrained weights exclude each other")
        require(mode in ("scratch", "resume"), f"unknown init_mode {mode!r}")
        return "resume"
    require(mode != "resume", "resume needs resume_from_checkpoint")
    require(mode in _MODES, f"unknown init_mode {mode!r}")
    require(_MODES[mode] == (weights, checkpoint), f"init_mode {mode} and pretrained_path do not agree")
    return mode


def check_generation(max_new_tokens: int, num_beams: int = 1, do_sample: bool = False) -> None:
    require(max_new_tokens > 0, "max_new_tokens is not positive")
    require(num_beams == 1 and not do_sample, "generation is greedy only")


def check_image_size(data: DataConfig, model: ModelConfig) -> None:
    require(data.image_size == model.encoder.image_size, "data and encoder differ in image_size")


def monitor(generation_metrics: bool) -> tuple[str, str]:
    """The metric that checkpoints are kept by, and its better end."""
    return ("BLEU", "max") if generation_metrics else ("val_loss", "min")


def checkpoint_name(epoch: int, step: int, metric: float) -> str:
    return CHECKPOINT_NAME.format(epoch=epoch, step=step, metric=metric)


def worker_seed(initial: int) -> int:
    return initial % WORKER_SEEDS


def absolute(path: str | None, base: str) -> str | None:
    """``path`` under ``base`` unless it is absolute already; none stays none."""
    return None if path is None else os.path.normpath(os.path.join(base, path))


def compose(base: Mapping[str, Any], *overrides: str) -> dict[str, Any]:
    """A nested mapping with ``dotted.key=value`` overrides; values are JSON where they parse as such. New keys need ``+``."""
    out = json.loads(json.dumps(base))
    for text in overrides:
        path, _, raw = text.removeprefix("+").partition("=")
        *outer, last = path.split(".")
        at = out
        for k in outer:
            require(isinstance(at.get(k), dict) or text.startswith("+"), f"no section {k!r}")
            at = at.setdefault(k, {})
        require(last in at or text.startswith("+"), f"no key {path!r}")
        try:
            at[last] = json.loads(raw)
        except json.JSONDecodeError:
            at[last] = raw
    return out
