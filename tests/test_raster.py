from __future__ import annotations

import numpy as np

from folioworks.operators import raster as r


def test_regions_and_boxes():
    m = np.zeros((20, 40))
    m[3:9, 5:20] = 0.9
    m[12:14, 30:31] = 0.9
    m[9, 20] = 0.9  # touches by a corner
    assert r.labelled(m > 0.3).max() == 2
    found = r.text_boxes(m)
    assert len(found) == 1 and found[0][1] > 0.6
    quad = np.array(found[0][0])
    assert quad[:, 0].min() < 5 and quad[:, 1].max() > 8 and (quad >= 0).all()
    assert r.text_boxes(np.zeros((4, 4))) == []


def test_rectangles():
    turn = np.array([[np.cos(0.4), np.sin(0.4)], [-np.sin(0.4), np.cos(0.4)]])
    box, w, h = r.least_rectangle(np.array([[0, 0], [8, 0], [8, 2], [0, 2], [4, 1]]) @ turn)
    assert abs(w * h - 16) < 1e-6
    square = np.array([[0, 0], [4, 0], [4, 4], [0, 4]], float)
    assert np.allclose(r.grown(square, 1.0), [[-1, -1], [5, -1], [5, 5], [-1, 5]])


def test_pixels():
    image = np.arange(12.0).reshape(3, 4)
    assert np.allclose(r.resized(image, 4, 3), image)
    assert np.allclose(r.resized(np.ones((5, 7, 3)), 3, 2), 1)
    assert np.allclose(r.cropped(image, [[0, 0], [4, 0], [4, 3], [0, 3]]), image)
    m = r.perspective(np.array([[0, 0], [1, 0], [1, 1], [0, 1]]), np.array([[1, 1], [3, 1], [4, 4], [0, 3]]))
    p = m @ [1, 1, 1]
    assert np.allclose(p[:2] / p[2], [4, 4])
    assert r.cropped(np.ones((9, 2)), [[0, 0], [2, 0], [2, 9], [0, 9]]).shape == (2, 9)
