"""Readers and writers: prices, search results, pages, fetch plan, snapshots."""
