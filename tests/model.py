"""Plain NumPy models of the operators, for small fixtures."""

import numpy as np


def mixed_checksum(text, rounds=1000):
    import zlib

    c = zlib.crc32(text.encode("utf-8"))
    for _ in range(rounds):
        c = ((c << 1) ^ (c >> 3)) & (2**64 - 1)
    return c - 2**64 if c >= 2**63 else c


def java_hash(text):
    h = 0
    units = text.encode("utf-16-be")
    for i in range(0, len(units), 2):
        h = (h * 31 + units[i] * 256 + units[i + 1]) & 0xFFFFFFFF
    return h - 2**32 if h >= 2**31 else h


def fnv1a(data):
    h = 0x811C9DC5
    for b in data:
        h = ((h ^ b) * 0x01000193) & 0xFFFFFFFF
    return h


def fired_windows(messages, length, step):
    """Windows by the rules: queue `step` messages, trim, evict, append."""
    window, queue, fired = [], [], []
    for m in messages:
        while len(window) > length:
            window.pop(0)
        queue.append(m)
        if len(queue) < step:
            continue
        if len(window) >= length:
            del window[:step]
        window += queue
        queue = []
        fired.append(list(window))
    return fired


def ray_pixels(n, theta, col, center):
    """[(pixel, chord)] of one ray by its crossings with all grid lines, in double."""
    offset = (1 - n) / 2 + col + (n / 2 - center + 1e-6)
    s, c = np.sin(theta), np.cos(theta)
    points = []
    for g in np.arange(-n / 2, n / 2 + 1):
        if c != 0 and abs((offset + g * s) / c) < n / 2:
            points.append((g, (offset + g * s) / c))
        if s != 0 and abs((g * c - offset) / s) < n / 2:
            points.append(((g * c - offset) / s, g))
    points.sort(key=lambda p: p[0] * c + p[1] * s)
    out = []
    for (x1, y1), (x2, y2) in zip(points, points[1:]):
        px, py = int(np.floor((x1 + x2) / 2 + n / 2)), int(np.floor((y1 + y2) / 2 + n / 2))
        out.append((px + py * n, np.hypot(x2 - x1, y2 - y1)))
    return out


def kernel_center(center, n):
    center = int(center or n / 2)
    return n / 2 + 1 if center <= 0 else center


def sirt_sweep(image, messages, n, center):
    """One sweep; messages are (theta, samples)."""
    num, den = np.zeros(n * n), np.zeros(n * n)
    for theta, samples in messages:
        for col in range(n):
            cells = ray_pixels(n, theta, col, center)
            norm = sum(w * w for _, w in cells)
            if not norm:
                continue
            sim = sum(image[p] * w for p, w in cells)
            for p, w in cells:
                num[p] += w * (samples[col] - sim) / norm
                den[p] += w
    with np.errstate(all="ignore"):
        change = num / den
    return image + np.where(np.isnan(change), 0.0, change)


def sirt(messages, n, length, step, sweeps, write_freq, job_center=0):
    """{pass0: image} of the emitted passes of one row; messages are (theta, center, samples)."""
    image, out = np.zeros(n * n), {}
    for pass0, window in enumerate(fired_windows(messages, length, step)):
        center = kernel_center(job_center or window[-1][1], n)
        for _ in range(sweeps):
            image = sirt_sweep(image, [(t, s) for t, _, s in window], n, center)
        if pass0 % write_freq == 0:
            out[pass0] = image.copy()
    return out
