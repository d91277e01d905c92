"""Stateful time stepping: the step loop, ensembles of scenarios, recordings that grow."""
