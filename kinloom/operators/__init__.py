"""kinloom.operators"""
