"""Readers and writers of snapshots, phrase documents, folds and inferences."""
