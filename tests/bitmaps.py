"""Small image files for tests."""

import numpy as np


def bmp(rgb):
    """A 24-bit bitmap of a height x width x 3 array."""
    h, w, _ = rgb.shape
    pad = b"\0" * (-3 * w % 4)
    body = b"".join(rgb[y, :, ::-1].astype(np.uint8).tobytes() + pad for y in reversed(range(h)))
    head = b"BM" + (54 + len(body)).to_bytes(4, "little") + bytes(4) + (54).to_bytes(4, "little")
    info = (40).to_bytes(4, "little") + w.to_bytes(4, "little") + h.to_bytes(4, "little") + (1).to_bytes(2, "little") + (24).to_bytes(2, "little") + bytes(24)
    return head + info + body
