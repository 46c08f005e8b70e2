"""Probabilistic automata from examples, by merging states of a prefix tree."""

from math import log, log2, sqrt

#: Chance that states alike are kept apart, for each comparison.
ALPHA = 0.05
SMOOTHING = 0.1


def differ(times: int, of: int, others: int, other_of: int, alpha: float) -> bool:
    """Hoeffding's bound: whether two frequencies are too far apart to be chance."""
    if not of or not other_of:
        return False
    return abs(times / of - others / other_of) > sqrt(0.5 * log(2 / alpha)) * (of**-0.5 + other_of**-0.5)


class PrefixTree:
    """States with the counts of visits, ends and steps; a step is [next state, times]."""

    def __init__(self, strings):
        self.visits, self.ends, self.steps = [0], [0], [{}]
        for string in strings:
            state = 0
            self.visits[0] += 1
            for symbol in string:
                step = self.steps[state].get(symbol)
                if step is None:
                    step = self.steps[state][symbol] = [len(self.visits), 0]
                    self.visits.append(0)
                    self.ends.append(0)
                    self.steps.append({})
                step[1] += 1
                state = step[0]
                self.visits[state] += 1
            self.ends[state] += 1

    def compatible(self, settled: int, tree: int, alpha: float) -> bool:
        """Whether two states end and go on alike, and all states below the second one too."""
        pending = [(settled, tree)]
        while pending:
            a, b = pending.pop()
            n, m = self.visits[a], self.visits[b]
            if differ(self.ends[a], n, self.ends[b], m, alpha):
                return False
            for symbol in self.steps[a].keys() | self.steps[b].keys():
                mine, yours = self.steps[a].get(symbol), self.steps[b].get(symbol)
                if differ(mine[1] if mine else 0, n, yours[1] if yours else 0, m, alpha):
                    return False
                if mine and yours:
                    pending.append((mine[0], yours[0]))
        return True

    def fold(self, into: int, tree: int) -> None:
        """Add the counts of a state that still roots a tree, and of all below it, to another."""
        pending = [(into, tree)]
        while pending:
            into, tree = pending.pop()
            self.visits[into] += self.visits[tree]
            self.ends[into] += self.ends[tree]
            for symbol, (child, times) in self.steps[tree].items():
                step = self.steps[into].get(symbol)
                if step is None:
                    self.steps[into][symbol] = [child, times]
                else:
                    step[1] += times
                    pending.append((step[0], child))


class Automaton:
    """A merged tree: `bits` is a string's negative log2 likelihood.

    `costliest` is the most bits that one of the examples takes per symbol, its end included.
    """

    def __init__(self, strings, symbols: int, alpha: float = ALPHA):
        tree = PrefixTree(strings)
        settled, number = [0], {0: 0}
        while True:
            # Of the states one step from the settled ones, the most visited has the best evidence.
            edge = [
                (-tree.visits[step[0]], place, symbol)
                for place, state in enumerate(settled)
                for symbol, step in tree.steps[state].items()
                if step[0] not in number
            ]
            if not edge:
                break
            _, place, symbol = min(edge)
            step = tree.steps[settled[place]][symbol]
            state = step[0]
            for other in settled:
                if tree.compatible(other, state, alpha):
                    step[0] = other
                    tree.fold(other, state)
                    break
            else:
                number[state] = len(settled)
                settled.append(state)
        self.steps, self.stop, self.unseen = [], [], []
        for state in settled:
            whole = tree.visits[state] + SMOOTHING * (symbols + 1)
            cost = lambda times, whole=whole: -log2((times + SMOOTHING) / whole)
            self.steps.append({s: (number[to], cost(n)) for s, (to, n) in tree.steps[state].items()})
            self.stop.append(cost(tree.ends[state]))
            self.unseen.append(cost(0))
        self.costliest = max((self.rate(string) for string in strings), default=0.0)

    def rate(self, string: str) -> float:
        return self.bits(string) / (len(string) + 1)

    def bits(self, string: str) -> float:
        """A symbol that a state has never seen costs its smoothed share and leaves the state."""
        state, total = 0, 0.0
        for symbol in string:
            step = self.steps[state].get(symbol)
            if step is None:
                total += self.unseen[state]
            else:
                state = step[0]
                total += step[1]
        return total + self.stop[state]
