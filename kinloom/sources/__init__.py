"""kinloom.sources"""
