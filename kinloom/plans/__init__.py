"""kinloom.plans"""
