"""DataFrame operators: prefix matching, policy, lifecycle, eviction, chunks, traces, vectors, simulation."""
