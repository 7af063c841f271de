"""Nearest segments of many points within one tile, on arrays.

The tile's segments are listed in the cells of a local grid that their lines pass; cells follow the tile's own number and length of
segments. A row of cells is one run of the list, so a search of all cells within a radius is a few runs for each point. Made by a
call, so that executors get it whole and need not have this package.
"""

from __future__ import annotations


def array_search(most_pairs: int = 1 << 20, run: int = 8):
    """index(segments, box) of an n x 4 array, and nearest(index, x, y, ties, most): distances, and with ``ties`` also the points and segments that meet them.

    A point that would have to be compared with more than ``most`` segments at once has infinity. For points far from all segments there are
    boxes(segments) and nearest_box(boxes, x, y, ties): three levels of boxes around neighbouring segments, opened while they may hold a nearer one.
    """
    import numpy as np

    def runs(first, count):
        """Numbers first, first + 1, ... for each count, and the place that each belongs to."""
        own = np.repeat(np.arange(len(count)), count)
        return own, np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count) + first[own]

    def index(segs, box, least=0.0, copies=False):
        segs = segs if copies else np.unique(segs, axis=0)
        x1, y1, x2, y2 = segs.T
        n = len(segs)
        # the part of the box that segments reach
        lox, loy = max(box[0], np.minimum(x1, x2).min()), max(box[1], np.minimum(y1, y2).min())
        hix, hiy = min(box[2], np.maximum(x1, x2).max()), min(box[3], np.maximum(y1, y2).max())
        wide, high = max(hix - lox, 0.0), max(hiy - loy, 0.0)
        across = max(wide, high)
        length = np.minimum(np.maximum(abs(x2 - x1), abs(y2 - y1)), across).sum()
        c = max((wide * high / n) ** 0.5, across / n, length / (8 * n), across / 1024, least) or 1.0
        gx, gy = int(wide / c) + 1, int(high / c) + 1
        slack = 1e-6 * c + 1e-12 * max(abs(lox), abs(loy), abs(hix), abs(hiy))
        row = lambda v: np.clip(np.floor((v - loy) / c), -1, gy)
        first = np.maximum(row(np.minimum(y1, y2) - slack), 0).astype(np.int64)
        last = np.minimum(row(np.maximum(y1, y2) + slack), gy - 1).astype(np.int64)
        s, r = runs(first, np.maximum(last - first + 1, 0))
        # the part of the line in a row of cells
        ax, ay, bx, by = (v[s] for v in (x1, y1, x2, y2))
        rise = by - ay
        with np.errstate(divide="ignore", invalid="ignore"):
            t1, t2 = (loy + r * c - slack - ay) / rise, (loy + (r + 1) * c + slack - ay) / rise
        flat = abs(rise) <= slack
        t1, t2 = (np.where(flat, e, np.clip(t, 0.0, 1.0)) for t, e in ((t1, 0.0), (t2, 1.0)))
        e1, e2 = ax + t1 * (bx - ax), ax + t2 * (bx - ax)
        column = lambda v: np.clip(np.floor((v - lox) / c), -1, gx)
        first = np.maximum(column(np.minimum(e1, e2) - slack), 0).astype(np.int64)
        last = np.minimum(column(np.maximum(e1, e2) + slack), gx - 1).astype(np.int64)
        k, cx = runs(first, np.maximum(last - first + 1, 0))
        cell = r[k] * gx + cx
        order = np.argsort(cell, kind="stable")
        starts = np.zeros(gx * gy + 1, dtype=np.int64)
        np.cumsum(np.bincount(cell, minlength=gx * gy), out=starts[1:])
        dx, dy = x2 - x1, y2 - y1
        return {"segs": segs, "parts": (x1, y1, x2, y2, dx, dy, dx * dx + dy * dy), "listed": s[k][order], "starts": starts, "grid": (lox, loy, c, gx, gy, slack)}

    def distance(index, px, py, s):
        """As functions.geometry.segment_distance, step by step."""
        x1, y1, x2, y2, dx, dy, len2 = (v[s] for v in index["parts"])
        with np.errstate(divide="ignore", invalid="ignore"):
            t = np.where(len2 > 0, ((px - x1) * dx + (py - y1) * dy) / len2, 0.0)
        fx = np.where(t <= 0, x1, np.where(t >= 1, x2, x1 + t * dx))
        fy = np.where(t <= 0, y1, np.where(t >= 1, y2, y1 + t * dy))
        return np.sqrt((px - fx) * (px - fx) + (py - fy) * (py - fy))

    def listed(index, x, y, radius):
        """(points, first, count): runs of the list that hold the cells within the radius."""
        lox, loy, c, gx, gy, slack = index["grid"]
        place = lambda v, low, end: np.clip(np.floor((v - low) / c), -1, end)
        reach = radius + slack
        top, bottom = place(y - reach, loy, gy), place(y + reach, loy, gy)
        left, right = place(x - reach, lox, gx), place(x + reach, lox, gx)
        top, left = (np.maximum(v, 0).astype(np.int64) for v in (top, left))
        bottom, right = np.minimum(bottom, gy - 1).astype(np.int64), np.minimum(right, gx - 1).astype(np.int64)
        p, r = runs(top, np.where(left <= right, np.maximum(bottom - top + 1, 0), 0))
        first = index["starts"][r * gx + left[p]]
        count = index["starts"][r * gx + right[p] + 1] - first
        return tuple(v[count > 0] for v in (p, first, count))

    def within(index, x, y, runs_of):
        """(points, segments, distances) of all pairs in the runs, some perhaps twice, in pieces of few pairs."""
        p, first, count = runs_of
        piece = (np.cumsum(count) - count) // most_pairs
        for a, b in zip(*(e.tolist() for e in (np.flatnonzero(np.diff(piece, prepend=-1)), np.append(np.flatnonzero(np.diff(piece)) + 1, len(piece))))) if len(piece) else ():
            own, at = runs(first[a:b], count[a:b])
            own, s = p[a:b][own], index["listed"][at]
            yield own, s, distance(index, x[own], y[own], s)

    def least(index, x, y, radius, most):
        """The nearest within the radius, or NaN for points with more than ``most`` segments there."""
        p, first, count = listed(index, x, y, radius)
        many = np.bincount(p, count, len(x)) > most
        best = np.where(many, np.nan, np.inf)
        kept = ~many[p]
        for p, _, d in within(index, x, y, (p[kept], first[kept], count[kept])):
            starts = np.flatnonzero(np.diff(p, prepend=-1))
            np.minimum.at(best, p[starts], np.minimum.reduceat(d, starts))
        return best

    def nearest(index, x, y, ties, most=np.inf):
        lox, loy, c, gx, gy, _ = index["grid"]
        away = lambda v, low, cells: np.maximum(np.maximum(low - v, v - (low + cells * c)), 0.0)
        radius = np.maximum(away(x, lox, gx), away(y, loy, gy)) + c / 4
        best, todo = np.full(len(x), np.inf), np.arange(len(x))
        # everything lies within this of a point
        whole = np.maximum(np.maximum(abs(x - lox), abs(x - lox - gx * c)), np.maximum(abs(y - loy), abs(y - loy - gy * c)))
        while len(todo):
            best[todo] = d = least(index, x[todo], y[todo], radius[todo], most)
            # what is nearer than a hit lies within it
            met = np.isfinite(d)
            done = (met & (d <= radius[todo])) | (radius[todo] >= whole[todo]) | np.isnan(d)
            radius[todo] = np.where(met, d * (1 + 1e-9), radius[todo] * 3)
            todo = todo[~done]
        best[np.isnan(best)] = np.inf
        if not ties:
            return best, None
        met, found = np.flatnonzero(np.isfinite(best)), []
        for p, s, d in within(index, x[met], y[met], listed(index, x[met], y[met], best[met] * (1 + 1e-9))):
            same = d == best[met][p]
            found.append(np.unique(np.stack([met[p[same]], s[same]]), axis=1))
        return best, np.unique(np.concatenate(found, axis=1), axis=1) if found else np.zeros((2, 0), dtype=np.int64)

    def spread_bits(v):
        for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
            v = (v | v << shift) & mask
        return v

    def boxes(segs):
        segs = np.unique(segs, axis=0)
        x, y = segs[:, 0] / 2 + segs[:, 2] / 2, segs[:, 1] / 2 + segs[:, 3] / 2
        across = max(np.ptp(x), np.ptp(y)) or 1.0
        # neighbours follow one another
        cell = lambda v: np.minimum((v - v.min()) / across * 2**20, 2**20 - 1).astype(np.int64)
        segs = segs[np.argsort(spread_bits(cell(x)) | spread_bits(cell(y)) << 1, kind="stable")]
        # filled up with copies, so that every box has as many children
        segs = np.concatenate([segs, np.repeat(segs[-1:], -len(segs) % run**3, axis=0)])
        x1, y1, x2, y2 = (np.ascontiguousarray(v) for v in segs.T)
        level, levels = (np.minimum(x1, x2), np.minimum(y1, y2), np.maximum(x1, x2), np.maximum(y1, y2)), []
        for _ in range(3):
            level = tuple(f.reduceat(v, np.arange(0, len(v), run)) for f, v in zip((np.minimum, np.minimum, np.maximum, np.maximum), level))
            levels.insert(0, level)
        dx, dy = x2 - x1, y2 - y1
        return {"segs": segs, "parts": (x1, y1, x2, y2, dx, dy, dx * dx + dy * dy), "levels": levels}

    def gap(level, x, y, node):
        """The square of the distance to a box."""
        lox, loy, hix, hiy = (v[node] for v in level)
        gx, gy = np.maximum(np.maximum(lox - x, x - hix), 0.0), np.maximum(np.maximum(loy - y, y - hiy), 0.0)
        return gx * gx + gy * gy

    def nearest_box(index, x, y, ties):
        levels, found = index["levels"], []
        best = np.full(len(x), np.inf)
        child = np.arange(run)
        step = max(1, most_pairs // len(levels[0][0]))
        opened = max(1, most_pairs // run**3)

        def down(p, node, upto, last):
            """Pairs of points and boxes of the first level, down to the segments that may be as near as ``upto``."""
            for level in levels[1:]:
                p, node = np.repeat(p, run), (node[:, None] * run + child).ravel()
                kept = gap(level, x[p], y[p], node) <= upto[p]
                p, node = p[kept], node[kept]
            if not last and len(p):
                # the nearest box of each point first
                low = gap(levels[-1], x[p], y[p], node)
                order = np.lexsort((low, p))
                order = order[np.flatnonzero(np.diff(p[order], prepend=-1))]
                lower(p[order], node[order])
                kept = low <= bound(p)
                p, node = p[kept], node[kept]
            return p, node

        def met(p, node):
            p, s = np.repeat(p, run), (node[:, None] * run + child).ravel()
            return p, s, distance(index, x[p], y[p], s)

        def bound(p):
            return best[p] * best[p] * (1 + 1e-9)

        def lower(p, node):
            p, _, d = met(p, node)
            np.minimum.at(best, p, d)

        for a in range(0, len(x), step):
            p = np.arange(a, min(a + step, len(x)))
            low = gap(levels[0], x[p, None], y[p, None], slice(None))
            node = low.argmin(axis=1)
            for level in levels[1:]:
                each = node[:, None] * run + child
                node = each[np.arange(len(p)), gap(level, x[p, None], y[p, None], each).argmin(axis=1)]
            lower(p, node)
            for last in (False, True) if ties else (False,):
                q, node = np.nonzero(low <= bound(p)[:, None])
                q += a
                for k in range(0, len(q), opened):
                    r, n = down(q[k : k + opened], node[k : k + opened], bound(np.arange(len(x))), last)
                    if last:
                        r, s, d = met(r, n)
                        same = d == best[r]
                        found.append(np.stack([r[same], s[same]]))
                    else:
                        lower(r, n)
        if not ties:
            return best, None
        pairs = np.concatenate(found, axis=1) if found else np.zeros((2, 0), dtype=np.int64)
        # copies are one segment
        _, own = np.unique(index["segs"][pairs[1]], axis=0, return_inverse=True)
        _, first = np.unique(np.stack([pairs[0], own.ravel()]), axis=1, return_index=True)
        return best, pairs[:, first]

    def polygon_index(segs, code, box, radius):
        """An index of polygons ``code``, 0, 1, ...: those with an edge in a cell, the edges of each, and one vertex of each by its cell."""
        made = index(segs, box, radius / 8, copies=True)
        lox, loy, c, gx, gy, _ = made["grid"]
        cell = np.repeat(np.arange(gx * gy), np.diff(made["starts"]))
        n = int(code.max()) + 1
        both = np.unique(cell * n + code[made["listed"]])
        upto = lambda counts: np.append(0, np.cumsum(counts))
        made["polygons"], made["first"] = both % n, upto(np.bincount(both // n, minlength=gx * gy))
        made["edges"], made["own"] = np.argsort(code, kind="stable"), upto(np.bincount(code, minlength=n))
        vertex = segs[made["edges"][made["own"][:-1]], :2]
        at = np.clip(np.floor((vertex[:, 1] - loy) / c), 0, gy - 1).astype(np.int64) * gx + np.clip(np.floor((vertex[:, 0] - lox) / c), 0, gx - 1).astype(np.int64)
        made["vertex"], made["by_cell"], made["vertices"] = vertex.T, np.argsort(at, kind="stable"), upto(np.bincount(at, minlength=gx * gy))
        return made

    def reached(index, x, y, p, polygon, radius):
        """Which pairs of points and polygons have an edge within the radius."""
        out = np.zeros(len(p), dtype=bool)
        first, count = index["own"][polygon], index["own"][polygon + 1] - index["own"][polygon]
        piece = (np.cumsum(count) - count) // most_pairs
        ends = np.append(np.flatnonzero(np.diff(piece, prepend=-1)), len(piece)).tolist()
        for a, b in zip(ends, ends[1:]):
            own, at = runs(first[a:b], count[a:b])
            q = p[a:b][own]
            out[a + own[distance(index, x[q], y[q], index["edges"][at]) <= radius]] = True
        return out

    def polygons_within(index, x, y, radius):
        """(points, polygons) with an edge within the radius, each once, in pieces."""
        lox, loy, c, gx, gy, slack = index["grid"]
        step = max(1, most_pairs // 4 // max(1, int(len(index["polygons"]) * min(1.0, (2 * radius / c + 2) ** 2 / (gx * gy)))))
        vx, vy = index["vertex"]
        sure = (radius * (1 - 1e-9)) ** 2
        away = lambda p, k: (vx[k] - x[p]) * (vx[k] - x[p]) + (vy[k] - y[p]) * (vy[k] - y[p])

        def cells(a, b, starts, listed):
            """Pairs of points a to b and what is listed in the cells within the radius."""
            place = lambda v, low, end: np.clip(np.floor((v - low) / c), -1, end)
            reach = radius + slack
            top, left = (np.maximum(place(v - reach, low, end), 0).astype(np.int64) for v, low, end in ((y[a:b], loy, gy), (x[a:b], lox, gx)))
            bottom, right = (np.minimum(place(v + reach, low, end), end - 1).astype(np.int64) for v, low, end in ((y[a:b], loy, gy), (x[a:b], lox, gx)))
            p, row = runs(top, np.where(left <= right, np.maximum(bottom - top + 1, 0), 0))
            first = starts[row * gx + left[p]]
            own, at = runs(first, starts[row * gx + right[p] + 1] - first)
            return p[own] + a, listed[at]

        for a in range(0, len(x), step):
            b = min(a + step, len(x))
            # a vertex within the radius tells at once; other polygons are looked at by their edges
            p, k = cells(a, b, index["vertices"], index["by_cell"])
            near = away(p, k) <= sure
            yield p[near], k[near]
            p, k = cells(a, b, index["first"], index["polygons"])
            far = away(p, k) > sure
            n = len(vx)
            both = np.unique(p[far] * n + k[far])
            p, k = both // n, both % n
            met = reached(index, x, y, p, k, radius)
            yield p[met], k[met]

    return index, nearest, boxes, nearest_box, polygon_index, reached, polygons_within
