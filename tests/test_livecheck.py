import threading

import pytest

from placeloom import livecheck as L
from placeloom.service import Service, serve


def test_urls(tmp_path):
    (tmp_path / "items").mkdir()
    (tmp_path / "samples").mkdir()
    (tmp_path / "a b.jpg").write_bytes(b"1")
    (tmp_path / "items" / "multimodal_items.jsonl").write_text('{"image_path": "none.jpg"}\n\n{"image_path": "a b.jpg"}\n{}\n')
    assert L.two_image_urls(tmp_path) == ["file://a b.jpg"]
    with pytest.raises(ValueError):
        L.request_for(L.two_image_urls(tmp_path))
    (tmp_path / "samples" / "cafe.jpg").write_bytes(b"1")
    assert L.two_image_urls(tmp_path) == ["file://a b.jpg", "file://samples/cafe.jpg"]
    assert L.file_url(tmp_path / "a b.jpg", tmp_path / "items").startswith("file:///")


def test_fallback_is_an_error(spark):
    answers = iter(['{"objects": ["a"]}'])
    server = serve(Service(spark, ask=lambda payload: next(answers)), port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}/v1/image-understanding"
    assert L.check(url, ["u", "v"])["structured_info"]["objects"] == ["a"]
    with pytest.raises(RuntimeError):
        L.check(url, ["u", "v"])
    server.shutdown()
