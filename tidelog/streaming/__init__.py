"""Structured Streaming queries; each states what keeps its state bounded."""
