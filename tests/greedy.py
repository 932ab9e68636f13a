"""The linkers one slice, detection and track at a time: what the rounds of dominant edges must equal."""

from collections import defaultdict


def choose(slice_ids, edges, tail_of, nearest_only):
    """Greedy one-to-one choice for one slice: detection -> track.

    edges lists, for a detection, (earlier detection, score, allowed); tail_of maps a track's last detection to the track.
    Ties go to the earlier detection, then the lower track. nearest_only: a detection has its nearest track or none."""
    offers = []
    for place, b in enumerate(slice_ids):
        mine = sorted((score, tail_of[a], ok) for a, score, ok in edges.get(b, ()) if a in tail_of)
        offers += [(score, place, track, ok) for score, track, ok in (mine[:1] if nearest_only else mine)]
    offers = [o for o in offers if o[3]]
    offers.sort(key=lambda o: o[:3])
    got = {}
    taken = set()
    for _, place, track, _ in offers:
        if slice_ids[place] not in got and track not in taken:
            got[slice_ids[place]] = track
            taken.add(track)
    return got


def fold(dets, edges, max_gap, nearest_only=False, many_to_one=False):
    """Track of every detection; dets are (slice, id) in order of slice and number. New tracks are numbered from 1 as they open."""
    slices = defaultdict(list)
    for z, i in dets:
        slices[z].append(i)
    track_of = {}
    tail = {}
    opened = 0
    for z in sorted(slices):
        if many_to_one:
            got = {b: track_of[min(edges[b], key=lambda e: (e[1], e[0]))[0]] for b in slices[z] if b in edges}
        else:
            tail = {t: (last, i) for t, (last, i) in tail.items() if z - last <= max_gap + 1}
            got = choose(slices[z], edges, {i: t for t, (_, i) in tail.items()}, nearest_only)
        for b in slices[z]:
            if b not in got:
                opened += 1
                got[b] = opened
            track_of[b] = got[b]
            tail[got[b]] = (z, b)
    return track_of
