"""Named hooks that add sources, preparation steps, features and models, or run around scoring."""

from pyspark.sql import DataFrame


class Hooks:
    """Registry of callables per hook name, in registration order."""

    NAMES = ("data_source", "preprocessor", "feature_method", "model", "before_prediction", "after_prediction")

    def __init__(self):
        self._table = {n: {} for n in self.NAMES}

    def register(self, hook, name, function):
        if hook not in self._table:
            raise ValueError(f"unknown hook {hook}")
        self._table[hook][name] = function
        return function

    def names(self, hook):
        return list(self._table[hook])

    def load_source(self, spark, name, **params) -> DataFrame:
        return self._table["data_source"][name](spark, **params)

    def apply(self, hook, name, df: DataFrame, **params) -> DataFrame:
        """Run one preparation or feature hook."""
        return self._table[hook][name](df, **params)

    def first_result(self, hook, *args, **params):
        """Result of the first registered callable that returns something."""
        for function in self._table[hook].values():
            out = function(*args, **params)
            if out is not None:
                return out
        return None

    def score(self, trained, df: DataFrame) -> DataFrame:
        """Score with the before and after hooks; a hook that returns nothing leaves the table as it is."""
        from millrace.operators.models import score

        around = lambda hook: (lambda d: (lambda r: d if r is None else r)(self.first_result(hook, d)))
        return score(trained, df, before=(around("before_prediction"),), after=(around("after_prediction"),))


def map_chunks(df: DataFrame, function, schema):
    """Apply a pandas function to every Arrow batch of the table, in parallel."""

    def run(batches):
        for pdf in batches:
            yield function(pdf)

    return df.mapInPandas(run, schema)
