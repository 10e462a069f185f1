"""A navigable small-world graph in layers (HNSW), built and searched for many vectors at once in numpy."""

from __future__ import annotations

import numpy as np


class Hnsw:
    """Unit vectors ``x`` (float32), inserted in the order given, in batches.

    Layer 0 holds all vectors, each higher layer about 1 / ``m`` of the one below, by a draw from the
    row number. A batch searches the graph so far from the top, takes its neighbours from what the
    search and the batch itself offer, by the diversity rule (a candidate nearer to a chosen neighbour than
    to the vector is passed over at first), and links back; lists that overflow are chosen anew.
    """

    def __init__(self, x: np.ndarray, m: int = 16, ef: int = 64, batch: int = 512):
        self.x = np.ascontiguousarray(x, np.float32)
        n = len(x)
        draw = np.random.default_rng(20240117).random(n)
        self.level = np.minimum((-np.log(np.maximum(draw, 1e-12)) / np.log(m)).astype(np.int64), 6)
        if n:
            self.level[0] = self.level.max()  # the first one is the entry
        top = int(self.level.max(initial=0))
        self.links = [np.full((n, 2 * m if k == 0 else m), -1, np.int32) for k in range(top + 1)]
        at = 0
        while at < n:
            size = min(batch, max(32, at))
            self._insert(np.arange(at, min(at + size, n)), ef)
            at += size

    # -- search ---------------------------------------------------------------------------------

    def _beam(self, q: np.ndarray, entry: np.ndarray, entry_sim: np.ndarray, layer: int, ef: int, seen: np.ndarray, keep: float | None = None, width: int = 4):
        """Best-first search of one layer for all queries at once.

        entry, entry_sim: (Q, e) starting points, -1 for none. Returns beams (ids, similarities), best
        first, and, with ``keep``, all (query, id) met with at least that similarity.
        """
        n_q, links = len(q), self.links[layer]
        ids = np.full((n_q, ef), -1, np.int64)
        sims = np.full((n_q, ef), -np.inf, np.float32)
        done = np.ones((n_q, ef), bool)
        e = min(entry.shape[1], ef)
        ids[:, :e], sims[:, :e] = entry[:, :e], np.where(entry[:, :e] >= 0, entry_sim[:, :e], -np.inf)
        done[:, :e] = entry[:, :e] < 0
        rows, cols = np.nonzero(entry >= 0)
        seen[rows, entry[rows, cols]] = True
        met_q, met_i = [], []
        if keep is not None:
            near = entry_sim[rows, cols] >= keep
            met_q.append(rows[near])
            met_i.append(entry[rows, cols][near])
        active = np.arange(n_q)
        while len(active):
            open_ = np.where(done[active], -np.inf, sims[active])
            pick = np.argsort(-open_, axis=1)[:, :width]
            ok = np.take_along_axis(open_, pick, 1) > -np.inf
            alive = ok.any(axis=1)
            active, pick, ok = active[alive], pick[alive], ok[alive]
            if not len(active):
                break
            done[active[:, None], pick] |= ok
            r, c = np.nonzero(ok)
            nb = links[ids[active[r], pick[r, c]]]
            qq, vv = self._fresh(np.repeat(active[r], nb.shape[1]), nb.ravel(), seen)
            if not len(qq):
                continue
            s = np.einsum("ij,ij->i", q[qq], self.x[vv])
            if keep is not None:
                near = s >= keep
                met_q.append(qq[near])
                met_i.append(vv[near])
            better = s > sims[qq, -1]
            qq, vv, s = qq[better], vv[better], s[better]
            if not len(qq):
                continue
            who, first, count = np.unique(qq, return_index=True, return_counts=True)
            rank = np.arange(len(qq)) - np.repeat(first, count)
            more_i = np.full((len(who), count.max()), -1, np.int64)
            more_s = np.full(more_i.shape, -np.inf, np.float32)
            line = np.repeat(np.arange(len(who)), count)
            more_i[line, rank], more_s[line, rank] = vv, s
            all_i = np.concatenate((ids[who], more_i), axis=1)
            all_s = np.concatenate((sims[who], more_s), axis=1)
            all_d = np.concatenate((done[who], more_i < 0), axis=1)
            order = np.argsort(-all_s, axis=1, kind="stable")[:, :ef]
            ids[who], sims[who], done[who] = (np.take_along_axis(z, order, 1) for z in (all_i, all_s, all_d))
        return ids, sims, (np.concatenate(met_q), np.concatenate(met_i)) if keep is not None else None

    def _fresh(self, qq: np.ndarray, vv: np.ndarray, seen: np.ndarray):
        """Different pairs not seen before, by query; they count as seen from now on."""
        good = vv >= 0
        key = np.unique(qq[good] * np.int64(seen.shape[1]) + vv[good])
        key = key[~seen.ravel()[key]]
        seen.ravel()[key] = True
        return key // seen.shape[1], key % seen.shape[1]

    def _descend(self, q: np.ndarray, until: int) -> tuple[np.ndarray, np.ndarray]:
        """Entry points for layer ``until`` from the layers above it."""
        entry = np.zeros((len(q), 1), np.int64)
        sim = (q @ self.x[0])[:, None]
        for layer in range(len(self.links) - 1, until, -1):
            entry, sim, _ = self._beam(q, entry, sim, layer, 4, np.zeros((len(q), len(self.x)), bool))
        return entry, sim

    def within(self, q: np.ndarray, least: float, ef: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, id) pairs found with a similarity of at least ``least``: what the beam of ``ef`` meets,
        then all that can be reached through vectors within it, however many they are."""
        out_q, out_i = [], []
        step = max(16, min(512, (1 << 26) // max(1, len(self.x))))
        for a in range(0, len(q), step):
            part = q[a : a + step]
            entry, sim = self._descend(part, 0)
            seen = np.zeros((len(part), len(self.x)), bool)
            _, _, (qq, vv) = self._beam(part, entry, sim, 0, ef, seen, least)
            out_q.append(qq + a)
            out_i.append(vv)
            while len(qq):
                new_q, new_v = [], []
                for b in range(0, len(qq), 1 << 14):
                    nb = self.links[0][vv[b : b + (1 << 14)]]
                    fq, fv = self._fresh(np.repeat(qq[b : b + (1 << 14)], nb.shape[1]), nb.ravel(), seen)
                    near = np.einsum("ij,ij->i", part[fq], self.x[fv]) >= least
                    new_q.append(fq[near])
                    new_v.append(fv[near])
                qq, vv = np.concatenate(new_q), np.concatenate(new_v)
                out_q.append(qq + a)
                out_i.append(vv)
        return (np.concatenate(out_q), np.concatenate(out_i)) if out_q else (np.empty(0, np.int64), np.empty(0, np.int64))

    # -- building -------------------------------------------------------------------------------

    def _insert(self, new: np.ndarray, ef: int) -> None:
        q = self.x[new]
        first = new[0] == 0
        entry, sim = np.zeros((len(new), 1), np.int64), (q @ self.x[0])[:, None]
        for layer in range(len(self.links) - 1, -1, -1):
            belongs = self.level[new] >= layer
            mates = np.where(belongs)[0]
            if not first:
                wide = ef if belongs.any() else 4
                entry, sim, _ = self._beam(q, entry, sim, layer, wide, np.zeros((len(q), len(self.x)), bool))
            if not len(mates):
                continue
            own = q[mates] @ q[mates].T
            np.fill_diagonal(own, -np.inf)
            top = np.argsort(-own, axis=1, kind="stable")[:, : min(16, len(mates) - 1)]
            cand = np.concatenate((new[mates][top], entry[mates]), axis=1) if not first else new[mates][top]
            csim = np.concatenate((np.take_along_axis(own, top, 1), sim[mates]), axis=1) if not first else np.take_along_axis(own, top, 1)
            if not cand.shape[1]:
                continue
            chosen = self._choose(cand, csim, self.links[layer].shape[1] // 2 if layer == 0 else self.links[layer].shape[1])
            self.links[layer][new[mates], : chosen.shape[1]] = chosen
            self._link_back(layer, np.repeat(new[mates], chosen.shape[1]), chosen.ravel())

    def _choose(self, cand: np.ndarray, sim: np.ndarray, m: int) -> np.ndarray:
        """Up to m of the candidates of each line, by the diversity rule, filled up with the nearest others."""
        order = np.argsort(-sim, axis=1, kind="stable")[:, : 3 * m]
        cand, sim = np.take_along_axis(cand, order, 1), np.take_along_axis(sim, order, 1)
        n, c = cand.shape
        taken = np.zeros((n, c), bool)
        for a in range(0, n, 256):
            v = self.x[np.maximum(cand[a : a + 256], 0)]
            among = v @ v.transpose(0, 2, 1)
            nearest = np.full((len(v), c), -np.inf, np.float32)
            count = np.zeros(len(v), np.int64)
            for j in range(c):
                ok = (cand[a : a + 256, j] >= 0) & (sim[a : a + 256, j] > nearest[:, j]) & (count < m)
                taken[a : a + 256, j] = ok
                count += ok
                nearest = np.where(ok[:, None], np.maximum(nearest, among[:, j]), nearest)
        rank = np.where(cand < 0, 2 * c, np.where(taken, 0, c)) + np.arange(c)
        best = np.argsort(rank, axis=1, kind="stable")[:, :m]
        return np.take_along_axis(cand, best, 1)

    def _link_back(self, layer: int, src: np.ndarray, dst: np.ndarray) -> None:
        links = self.links[layer]
        m = links.shape[1]
        good = dst >= 0
        src, dst = src[good], dst[good]
        there = (links[dst] == src[:, None]).any(axis=1)
        src, dst = src[~there], dst[~there]
        order = np.argsort(dst, kind="stable")
        src, dst = src[order], dst[order]
        while len(dst):
            who, first, count = np.unique(dst, return_index=True, return_counts=True)
            rank = np.arange(len(dst)) - np.repeat(first, count)
            now = rank < m
            fresh = np.full((len(who), m), -1, np.int64)
            fresh[np.repeat(np.arange(len(who)), count)[now], rank[now]] = src[now]
            both = np.concatenate((links[who].astype(np.int64), fresh), axis=1)
            both = np.take_along_axis(both, np.argsort(both < 0, axis=1, kind="stable"), 1)
            fits = (both >= 0).sum(axis=1) <= m
            links[who[fits]] = both[fits, :m]
            if not fits.all():
                over, cand = who[~fits], both[~fits]
                sim = np.einsum("ij,ikj->ik", self.x[over], self.x[np.maximum(cand, 0)])
                links[over] = self._choose(cand, np.where(cand < 0, -np.inf, sim), m)
            src, dst = src[~now], dst[~now]
