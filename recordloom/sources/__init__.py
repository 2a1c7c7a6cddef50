"""Tables, archive files, exports and claims."""
