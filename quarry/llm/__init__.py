"""Training-data operators and their queries; nothing else in the library imports this package."""
