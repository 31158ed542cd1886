import os
import struct
import sys
import zlib

import numpy as np
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
# Python workers unpickle scorers defined in the tests
os.environ["PYTHONPATH"] = os.pathsep.join(
    [ROOT, os.path.join(ROOT, "tests"), os.environ.get("PYTHONPATH", "")])

from verigauge.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session(8, 8, "tests")
    yield s
    s.stop()


def png_bytes(img: np.ndarray) -> bytes:
    """A tiny PNG writer, so that tests need no imaging library."""
    h, w, _ = img.shape
    raw = b"".join(b"\x00" + img[i].tobytes() for i in range(h))

    def chunk(kind: bytes, data: bytes) -> bytes:
        return (struct.pack(">I", len(data)) + kind + data
                + struct.pack(">I", zlib.crc32(kind + data)))
    return (b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0))
            + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


@pytest.fixture
def picture_tree(tmp_path):
    """real/ and fake/ folders with pictures, one broken picture and other files."""
    rng = np.random.default_rng(3)
    for cls, sub, base in (("real", "camera1", 60), ("fake", "gen1", 180)):
        d = tmp_path / "set" / cls / sub
        d.mkdir(parents=True)
        for i in range(6):
            img = np.clip(rng.normal(base, 12, (20, 24, 3)), 0, 255).astype(np.uint8)
            (d / f"{cls[0]}{i}.png").write_bytes(png_bytes(img))
    (tmp_path / "set" / "fake" / "gen1" / "broken.png").write_bytes(b"not a picture")
    (tmp_path / "set" / "notes.txt").write_text("hello")
    hidden = tmp_path / "set" / ".cache"
    hidden.mkdir()
    (hidden / "x.png").write_bytes(b"")
    return str(tmp_path / "set")
