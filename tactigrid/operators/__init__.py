"""DataFrame -> DataFrame operators over long pixel tables."""
