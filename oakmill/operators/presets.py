"""Ready services: public model APIs as requests and answers in JSON, and models that run in the executors.

None of them is called here without a key and a network; ``transport`` (as for ``HTTPService``) replaces the network.
"""

from __future__ import annotations

import functools
import json
import os
import urllib.request
import uuid
from collections.abc import Callable
from typing import Any

import pandas as pd

from oakmill.operators.services import ANY, HTTPService, Service


def _bearer(key: str) -> dict:
    return {"Authorization": f"Bearer {key}"}


def _read(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def post_file(url: str, headers: dict, body: dict, timeout: float = 60.0) -> Any:
    """Posts the bytes of the file ``body["file"]`` as they are."""
    request = urllib.request.Request(url, _read(body["file"]), {"Content-Type": "application/octet-stream", **headers})
    with urllib.request.urlopen(request, timeout=timeout) as answer:
        return json.loads(answer.read())


def form(body: dict) -> tuple[bytes, str]:
    """A multipart form: its bytes and its content type. ``file`` is a path, all else text."""
    mark, parts = uuid.uuid4().hex, []
    for name, value in body.items():
        named = f'; filename="{os.path.basename(value)}"' if name == "file" else ""
        content = _read(value) if name == "file" else str(value).encode()
        parts.append(f'--{mark}\r\nContent-Disposition: form-data; name="{name}"{named}\r\n\r\n'.encode() + content + b"\r\n")
    return b"".join([*parts, f"--{mark}--\r\n".encode()]), f"multipart/form-data; boundary={mark}"


def post_form(url: str, headers: dict, body: dict, timeout: float = 60.0) -> Any:
    data, kind = form(body)
    with urllib.request.urlopen(urllib.request.Request(url, data, {**headers, "Content-Type": kind}), timeout=timeout) as answer:
        return json.loads(answer.read())


def openai_chat(name: str, key: str, model: str, prompt: tuple[str, str] = ("", ""), url: str = "https://api.openai.com/v1/chat/completions", **options) -> HTTPService:
    """A text in, the text of each choice out. ``prompt`` is put before and after the input."""
    defaults = [(("model",), model), (("messages", 0, "role"), "user")]
    return HTTPService(name, url, [("messages", 0, "content")], [("choices", ANY, "message", "content")], headers=_bearer(key), defaults=defaults, wrap=prompt, **options)


def openai_images(name: str, key: str, url: str = "https://api.openai.com/v1/images/generations", **options) -> HTTPService:
    """A description in, the address of each picture out."""
    return HTTPService(name, url, [("prompt",)], [("data", ANY, "url")], headers=_bearer(key), **options)


def openai_audio(name: str, key: str, model: str = "whisper-1", url: str = "https://api.openai.com/v1/audio/transcriptions", **options) -> HTTPService:
    """The path of a recording, which all executors can read, in; its text out."""
    return HTTPService(name, url, [("file",)], [("text",)], headers=_bearer(key), defaults=[(("model",), model)], **({"transport": post_form} | options))


def huggingface_text(name: str, key: str, model: str, outputs: list[tuple], url: str = "https://api-inference.huggingface.co/models", **options) -> HTTPService:
    """A text in; ``outputs`` are paths into the model's answer, as ``[(0, ANY, "label"), (0, ANY, "score")]`` for classes."""
    return HTTPService(name, f"{url}/{model}", [("inputs",)], outputs, headers=_bearer(key), **options)


def huggingface_file(name: str, key: str, model: str, outputs: list[tuple], url: str = "https://api-inference.huggingface.co/models", **options) -> HTTPService:
    """The path of a picture or recording in, as ``[(ANY, "label"), (ANY, "score")]`` out."""
    return HTTPService(name, f"{url}/{model}", [("file",)], outputs, headers=_bearer(key), **({"transport": post_file} | options))


def google_vision(name: str, key: str, feature: str, outputs: list[tuple], url: str = "https://vision.googleapis.com/v1/images:annotate", **options) -> HTTPService:
    """The address of a picture in; ``outputs`` are paths below its answer, as ``[("safeSearchAnnotation", "adult")]``."""
    defaults = [(("requests", 0, "features", 0, "type"), feature)]
    return HTTPService(name, f"{url}?key={key}", [("requests", 0, "image", "source", "imageUri")], [("responses", 0, *path) for path in outputs], defaults=defaults, **options)


class ModelService(Service):
    """A model that each worker loads once (``load()``) and that answers batches: ``run(model, frame)`` gives a list with a
    frame for each input, or one frame with a row for each. For detectors and text recognition that run locally."""

    def __init__(self, name: str, load: Callable[[], Any], run: Callable[[Any, pd.DataFrame], Any], **options):
        super().__init__(name, **options)
        self.load, self.run, self.token = load, run, uuid.uuid4().hex

    def infer_batch(self, rows: pd.DataFrame) -> list[pd.DataFrame]:
        out = self.run(_loaded(self.token, self.load), rows)
        return [out.iloc[k : k + 1] for k in range(len(out))] if isinstance(out, pd.DataFrame) else list(out)

    def calls(self, rows: int) -> int:
        return 1


class _Key(str):
    """Equal by its text; carries the loader past the cache's key."""

    load: Callable[[], Any]


@functools.lru_cache(maxsize=4)
def _held(key: _Key) -> Any:
    return key.load()


def _loaded(token: str, load: Callable[[], Any]) -> Any:
    key = _Key(token)
    key.load = load
    return _held(key)


def torch_detector(name: str, weights: str, labels: list[str], least: float = 0.5, **options) -> ModelService:
    """Objects in pictures by a TorchScript detector: a path in, (label, score, x_min, y_min, x_max, y_max) of each object out.
    It needs torch and torchvision on the executors."""

    def load():
        import torch

        return torch.jit.load(weights).eval()

    def run(model, rows: pd.DataFrame) -> list[pd.DataFrame]:
        import torch
        from torchvision.io import read_image

        found = []
        with torch.no_grad():
            for path in rows.iloc[:, 0]:
                ((answer,),) = (model([read_image(path).float() / 255])[1:],)
                keep = [k for k, s in enumerate(answer["scores"].tolist()) if s >= least]
                found.append(pd.DataFrame([[labels[int(answer["labels"][k])], float(answer["scores"][k]), *map(float, answer["boxes"][k])] for k in keep], columns=range(6)))
        return found

    return ModelService(name, load, run, **options)
