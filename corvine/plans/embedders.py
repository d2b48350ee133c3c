"""Text embedders. One holds what its workers need and is sent to them; models load lazily in each worker."""

from __future__ import annotations

import logging
import os
import re
import zlib
from typing import Protocol

import numpy as np
from pyspark.sql import DataFrame

BATCH = 32
LONGEST = 128


class Embedder(Protocol):
    def embed(self, texts: list[str]) -> list[list[float]]: ...


def unit(v: np.ndarray) -> np.ndarray:
    """Rows of unit length; zero rows stay."""
    norm = np.linalg.norm(v, axis=1, keepdims=True)
    return np.divide(v, norm, out=np.zeros_like(v), where=norm > 0)


def mean_pool(hidden: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Mean over the tokens that the mask keeps."""
    weight = mask.astype(np.float32)[:, :, None]
    return (hidden * weight).sum(1) / np.maximum(weight.sum(1), 1e-9)


class HashingEmbedder:
    """Signed hashes of words and word pairs; needs no model, and is the same everywhere."""

    def __init__(self, dimension: int = 384) -> None:
        self.dimension = dimension

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), self.dimension), np.float32)
        for i, text in enumerate(texts):
            words = re.findall(r"\w+", text.lower())
            for piece in [*words, *map(" ".join, zip(words, words[1:], strict=False))]:
                h = zlib.crc32(piece.encode())
                out[i, (h >> 1) % self.dimension] += 1 if h & 1 else -1
        return unit(out).tolist()


class OnnxEmbedder:
    """A sentence model from a directory with model_quantized.onnx and tokenizer.json; nothing is downloaded."""

    def __init__(self, directory: str, threads: int = 2) -> None:
        self.directory, self.threads, self.ready = directory, threads, None
        for name in ("model_quantized.onnx", "tokenizer.json"):
            if not os.path.exists(os.path.join(directory, name)):
                raise FileNotFoundError(os.path.join(directory, name))

    def __getstate__(self) -> dict:
        return self.__dict__ | {"ready": None}

    def _load(self):
        if self.ready is None:
            import onnxruntime
            from tokenizers import Tokenizer

            options = onnxruntime.SessionOptions()
            options.intra_op_num_threads = self.threads
            session = onnxruntime.InferenceSession(os.path.join(self.directory, "model_quantized.onnx"), options)
            self.ready = session, Tokenizer.from_file(os.path.join(self.directory, "tokenizer.json"))
        return self.ready

    def embed(self, texts: list[str]) -> list[list[float]]:
        session, tokenizer = self._load()
        out = []
        for a in range(0, len(texts), BATCH):
            coded = [e.ids[:LONGEST] for e in tokenizer.encode_batch(texts[a : a + BATCH])]
            width = max(map(len, coded), default=0)
            ids, mask = (np.zeros((len(coded), width), np.int64) for _ in range(2))
            for i, c in enumerate(coded):
                ids[i, : len(c)], mask[i, : len(c)] = c, 1
            feed = {"input_ids": ids, "attention_mask": mask, "token_type_ids": np.zeros_like(ids)}
            wanted = {i.name for i in session.get_inputs()}
            names = [o.name for o in session.get_outputs()]
            name = next((n for n in ("last_hidden_state", "token_embeddings") if n in names), names[0])
            hidden = session.run([name], {k: v for k, v in feed.items() if k in wanted})[0]
            out += unit(mean_pool(hidden, mask)).tolist()
        return out


def embed_texts(rows: DataFrame, embedder: Embedder) -> DataFrame:
    """rows: key columns and text. The text is replaced by its vector; a text on which the embedder fails gives
    no row, so that it is found by its words only, and the others of its batch keep theirs."""
    keep = [c for c in rows.columns if c != "text"]
    kinds = dict(rows.dtypes)

    def run(batches):
        for pdf in batches:
            texts = pdf["text"].tolist()
            try:
                vectors = embedder.embed(texts)
            except Exception:  # one text at a time, to lose only those that fail
                vectors = [_one(embedder, t) for t in texts]
            good = [v is not None for v in vectors]
            yield pdf.loc[good, keep].assign(embedding=[v for v in vectors if v is not None])

    return rows.mapInPandas(run, ", ".join(f"{c} {kinds[c]}" for c in keep) + ", embedding array<float>")


def _one(embedder: Embedder, text: str) -> list[float] | None:
    try:
        return embedder.embed([text])[0]
    except Exception as e:
        logging.warning("no vector: %s: %s", type(e).__name__, e)
        return None
