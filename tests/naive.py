"""A second, slow evaluator by plain recursion over decoded JSON, to hold the engine against."""

import json


def nodes(text: str):
    """(path, value) of every node in document order; objects are lists of pairs, so repeated keys stay."""

    class Obj(list):
        pass

    def walk(path, v):
        yield path, v
        if isinstance(v, Obj):
            for n, (k, x) in enumerate(v):
                yield from walk((*path, ("key", k, n)), x)
        elif isinstance(v, list):
            for i, x in enumerate(v):
                yield from walk((*path, ("item", i, i)), x)

    return list(walk((), json.loads(text, object_pairs_hook=Obj)))


def matches(path, segments) -> bool:
    """Whether segments lead to a node of that path; segments are (descendant, test), test takes (kind, key)."""
    if not segments:
        return not path
    (descendant, test), rest = segments[0], segments[1:]
    for k in range(len(path)) if descendant else range(min(1, len(path))):
        if test(path[k][0], path[k][1]) and matches(path[k + 1 :], rest):
            return True
    return False


def select(text: str, segments) -> list[int]:
    """The numbers, in document order, of the nodes that segments select."""
    return [i for i, (path, _) in enumerate(nodes(text)) if matches(path, segments)]
