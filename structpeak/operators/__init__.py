"""DataFrame operators: series, registry, sampling, model, labels, evaluation, merge."""
