"""Operators over documents, mentions, entities, edits and risks."""
