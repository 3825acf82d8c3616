"""Plan building blocks shared by the operators: sizing, ordering, quantiles, lookups, quotas."""
