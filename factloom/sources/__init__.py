"""Readers: article histories, archives, feeds, captures, search results, URL lists, batches, rules."""
