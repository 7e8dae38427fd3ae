"""Rewards to load by 'path:name': a function of a list of rows that gives a list of scores."""


def length_reward(rows, scale=1.0):
    return [{"reward": scale * len(r["response"])} for r in rows]


def best_of_group(rows, summary=None):
    """1 for the longest responses of a group, else 0: a reward that looks across rows, or at what is known of all of them."""
    most = _longest(rows) if summary is None else summary
    return [{"reward": float(len(r["response"]) == most)} for r in rows]


def _longest(rows):
    return max(len(r["response"]) for r in rows)


best_of_group.summary, best_of_group.merge = _longest, max
