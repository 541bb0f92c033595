"""A check of a running service with two images: a real model has to answer, not the fallback."""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Iterable
from pathlib import Path


def file_url(image: Path, root: Path) -> str:
    """A url relative to ``root`` for files in it, else an absolute one."""
    image, root = image.resolve(), root.resolve()
    return f"file://{image.relative_to(root).as_posix()}" if image.is_relative_to(root) else image.as_uri()


def two_image_urls(root: str | Path, items: str = "items/multimodal_items.jsonl", sample: str = "samples/cafe.jpg") -> list[str]:
    """The first two images that exist among the items of a JSON-lines file; the sample fills up."""
    root = Path(root)
    listed: Iterable[str] = (root / items).read_text(encoding="utf-8").splitlines() if (root / items).exists() else ()
    found = []
    for line in listed:
        path = root / (json.loads(line).get("image_path") or ".") if line.strip() else root
        if path.is_file() and len(found) < 2:
            found.append(file_url(path, root))
    if (root / sample).is_file():
        found += [file_url(root / sample, root)] * (2 - len(found))
    return found


def request_for(urls: list[str]) -> dict:
    if len(urls) < 2:
        raise ValueError("the check needs two images")
    return {"image_urls": urls[:2], "user_text": "Compare both images and name the travel search signals they share.", "language": "zh", "prompt_version": "prompt_image_understanding_v1"}


def check(endpoint: str, urls: list[str], timeout: int = 120) -> dict:
    """The service's answer; RuntimeError if it is the fallback's."""
    request = urllib.request.Request(endpoint, json.dumps(request_for(urls)).encode(), {"Content-Type": "application/json"})
    with urllib.request.urlopen(request, timeout=timeout) as response:
        answer = json.load(response)
    if "fallback used" in (answer.get("raw_model_output") or ""):
        raise RuntimeError(f"no model answered: {answer['raw_model_output']}")
    return answer
