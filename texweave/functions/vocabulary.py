"""The token vocabulary: ids 0..3 are special, the others follow file order."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass
from functools import cached_property
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType

# Fixed values of the format.
BOS, PAD, EOS, UNK = 0, 1, 2, 3
SPECIAL = ("<bos>", "<pad>", "<eos>", "<unk>")

#: Control sequences of the default vocabulary; a full one is given by file.
COMMANDS = (
    r"\alpha \beta \gamma \delta \epsilon \theta \lambda \mu \pi \sigma \phi \omega \Gamma \Delta \Sigma \Omega \frac \sqrt \sum \int \prod \lim "
    r"\left \right \cdot \times \pm \leq \geq \neq \infty \partial \nabla \in \to \rightarrow \mathrm \mathbf \hat \bar \vec \sin \cos \log \ln \exp "
    r"\quad \ldots \begin{array} \end{array} \\ \{ \} \, \; \!"
).split()


@dataclass(frozen=True)
class Vocabulary:
    entries: tuple[str, ...]

    def __post_init__(self) -> None:
        if len(set(self.entries)) != len(self.entries) or set(self.entries) & set(SPECIAL):
            raise ValueError("vocabulary entries must be unique and none of the special tokens")

    @classmethod
    def core(cls) -> Vocabulary:
        """Printable ASCII without ``# $ % \\``, two ideographic stops, and COMMANDS."""
        letters = [chr(c) for c in range(0x21, 0x7F) if chr(c) not in "#$%\\"]
        return cls((*letters, "、", "。", *COMMANDS))

    @classmethod
    def load(cls, path: str, size: int | None = None) -> Vocabulary:
        """Non-empty lines of a text file; ``size`` is checked if given."""
        found = tuple(x for x in Path(path).read_text(encoding="utf-8").split("\n") if x)
        if size is not None and len(found) != size:
            raise ValueError(f"expected {size} vocabulary entries, found {len(found)}")
        return cls(found)

    @cached_property
    def tokens(self) -> tuple[str, ...]:
        return (*SPECIAL, *self.entries)

    @cached_property
    def ids(self) -> dict[str, int]:
        return {t: i for i, t in enumerate(self.tokens)}

    def __len__(self) -> int:
        return len(self.tokens)

    @cached_property
    def sha256(self) -> str:
        return hashlib.sha256(("\n".join(self.tokens) + "\n").encode()).hexdigest()

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(enumerate(self.tokens)), "token_id int, token string")

    def save(self, folder: str) -> dict:
        """Writes the vocabulary and a manifest of its contract; returns the manifest."""
        out = Path(folder)
        out.mkdir(parents=True, exist_ok=True)
        manifest = {"artifact_version": "1.0.0", "size": len(self), "special": dict(zip(SPECIAL, (BOS, PAD, EOS, UNK))), "sha256": self.sha256}
        (out / "vocabulary.json").write_text(json.dumps(self.ids, ensure_ascii=False, indent=2) + "\n", encoding="utf-8")
        (out / "manifest.json").write_text(json.dumps(manifest, indent=2, sort_keys=True) + "\n", encoding="utf-8")
        return manifest

    @classmethod
    def from_saved(cls, folder: str) -> Vocabulary:
        """Reads what ``save`` wrote and checks ids, special tokens and hash."""
        ids = json.loads((Path(folder) / "vocabulary.json").read_text(encoding="utf-8"))
        ordered = sorted(ids, key=ids.get)
        if [ids[t] for t in ordered] != list(range(len(ids))) or tuple(ordered[:4]) != SPECIAL:
            raise ValueError("vocabulary ids must be contiguous and begin with the special tokens")
        found = cls(tuple(ordered[4:]))
        if json.loads((Path(folder) / "manifest.json").read_text())["sha256"] != found.sha256:
            raise ValueError("vocabulary does not match its manifest")
        return found


def unknown_count(tokens: Column, vocabulary: Vocabulary) -> Column:
    """How many tokens are outside the vocabulary: one scan of a literal set, no join."""
    return F.size(F.filter(tokens, lambda t: ~t.isin(list(vocabulary.entries))))


def encode(rows: DataFrame, vocabulary: Vocabulary, tokens: str = "tokens", ids: str = "ids", special: bool = True) -> DataFrame:
    """``rows`` with the ids of an array of tokens, between BOS and EOS unless ``special`` is off.

    A dictionary per Arrow batch: no explosion of tokens and no shuffle.
    """
    known = vocabulary.ids

    def run(column: pd.Series) -> pd.Series:
        return column.map(lambda x: None if x is None else ([BOS] if special else []) + [known.get(t, UNK) for t in x] + ([EOS] if special else []))

    return rows.withColumn(ids, F.pandas_udf(run, ArrayType(IntegerType()))(F.col(tokens)))


def decode(rows: DataFrame, vocabulary: Vocabulary, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``rows`` with the text of ids, special ones left out; ids outside the vocabulary give nothing."""
    tokens = vocabulary.tokens

    def run(column: pd.Series) -> pd.Series:
        return column.map(lambda x: None if x is None else " ".join(tokens[i] for i in x if 3 < i < len(tokens)))

    return rows.withColumn(text, F.pandas_udf(run, StringType())(F.col(ids)))
