"""A cache of bounded size for what a Python worker computes again and again."""


class GenerationCache(dict):
    """Computes a missing value once; keeps what was used among the last ``size`` to 2 * ``size`` entries.

    When full, the entries become the old generation; an old entry in use moves back.
    Look-ups by ``cache[key]`` or ``map(cache.__getitem__, keys)``.
    """

    def __init__(self, compute, size=150_000, longest=64):
        super().__init__()
        self.compute, self.size, self.longest, self.old = compute, size, longest, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
            # Keys of any length would make the size of the cache unbounded.
            if len(key) > self.longest:
                return value
        self.put(key, value)
        return value

    def put_all(self, values):
        """``values`` (a dict) as new entries."""
        if len(self) + len(values) > self.size:
            self.old = dict(self)
            self.clear()
        self.update(values)

    def put(self, key, value):
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[key] = value
